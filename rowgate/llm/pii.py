"""Personal data: patterns, and a skip-chain conditional random field over what they leave.

Patterns find the base spans. A field over the document's candidate tokens (those with a digit
or an at sign) then labels what looks like, or repeats, personal data in another form: neighbours
share a chain potential, and tokens that are equal, end in the same seven digits, or repeat the
local part of an address share a skip potential, however far apart they are. Loopy belief
propagation gives each token's label distribution; tokens that the patterns found are observed.
Tokens without a digit or an at sign have no label but "none" and send no messages, so leaving
them out changes nothing.

The potentials are trained by pieces, in closed form: smoothed log frequencies of a token's
label given its shape, and log ratios of label pairs over chain and skip edges, with the base
spans of at most ``FIT_ROWS`` documents (chosen by a hash) as labels.

Defined results: null and empty texts have no spans. Rows are never grouped, so repeated rows
and null ids give one result each. An empty table trains a field that adds nothing. Other
columns are kept by ``redact`` and not read by the rest.

Scale: training brings counts of shapes (``SHAPES`` at most) to the driver; labelling is one
pass without a shuffle, linear in the text: equal tokens are linked in a row, not in pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # the first is "none"
FIT_ROWS = 20_000
SHAPES = 20_000
ADD_AT = 0.9  # least probability of an added token's label
ROUNDS = 30

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that begins inside a run of digits could begin at the run's start, so only that is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
_EDGES = ".,;:!?\"'<>[]{}|*#$%&="

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches: an address begins where its run of local characters does, or at the last match's end."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str | None) -> list[Span]:
    """Spans of the patterns, by start and then kind."""
    text = text or ""
    out = _emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


@dataclass
class Token:
    place: int  # among all tokens of the text
    start: int
    end: int
    text: str
    label: int = 0  # of the base span that it overlaps


def candidates(text: str | None, base: list[Span]) -> list[Token]:
    """The tokens with a digit or an at sign, and their base labels."""
    if not text or not _MARK.search(text):
        return []
    out, spans = [], sorted(base, key=lambda s: s[1])
    at = 0
    for place, m in enumerate(_TOKEN.finditer(text)):
        token = m.group()
        if not _MARK.search(token):
            continue
        left = len(token) - len(token.lstrip(_EDGES))
        token = token.strip(_EDGES)
        if not _MARK.search(token):
            continue
        start = m.start() + left
        made = Token(place, start, start + len(token), token)
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        near = at
        while near < len(spans) and spans[near][1] < made.end:
            if spans[near][2] > start:
                made.label = spans[near][0] + 1
                break
            near += 1
        out.append(made)
    return out


def shape(token: str) -> str:
    """Runs of digits with their lengths, letters as one, other characters as they are; then what it passes."""
    runs = _RUNS.findall(token[:64])
    form = "".join(f"d{len(r)}" if r[0].isdigit() else "a" if r[0].isalpha() else r for r in runs[:16])
    digits = "".join(c for c in token if "0" <= c <= "9")
    passes = 14 <= len(digits) <= 19 and luhn(digits)
    return f"{form}{'~' if len(runs) > 16 or len(token) > 64 else ''}{' luhn' if passes else ''}"


def skip_keys(token: str) -> list[str]:
    keys = [token.casefold()]
    if "@" in token:
        keys.append(token.partition("@")[0].casefold())
    digits = "".join(c for c in token if "0" <= c <= "9")
    if len(digits) >= 7:
        keys.append(digits[-7:])
    return keys


def edges(tokens: list[Token]) -> list[tuple[int, int, int]]:
    """(one, other, 0 for chain or 1 for skip); equal tokens are linked to the next such one only."""
    out, last = [], {}
    for i, token in enumerate(tokens):
        if i and token.place == tokens[i - 1].place + 1:
            out.append((i - 1, i, 0))
        linked = set()
        for key in dict.fromkeys(skip_keys(token.text)):
            j = last.get(key)
            if j is not None and j not in linked:
                linked.add(j)
                out.append((j, i, 1))
            last[key] = i
    return out


@dataclass
class Crf:
    """Log potentials: of labels per shape, and of label pairs over chain and skip edges."""

    unary: dict[str, list[float]] = field(default_factory=dict)
    unseen: list[float] = field(default_factory=lambda: [0.0] + [-9.0] * len(KINDS))
    pair: list = field(default_factory=lambda: np.zeros((2, LABELS, LABELS)).tolist())

    def marginals(self, tokens: list[Token]) -> np.ndarray:
        """Label distribution of each token by damped loopy belief propagation."""
        unary = np.array([self.unary.get(shape(t.text), self.unseen) for t in tokens])
        seen = [i for i, t in enumerate(tokens) if t.label]
        unary[seen] = -50.0
        unary[seen, [tokens[i].label for i in seen]] = 0.0
        links = edges(tokens)
        if links:
            unary = self._beliefs(unary, np.array(links))
        p = np.exp(unary - unary.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def _beliefs(self, unary: np.ndarray, links: np.ndarray) -> np.ndarray:
        potential = np.array(self.pair)[links[:, 2]]
        # every edge in both directions; opposite[e] is e's other direction
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        opposite = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        sent = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, target, sent)
            known = belief[source] - sent[opposite]
            scores = known[:, :, None] + potential
            top = scores.max(axis=1, keepdims=True)
            new = np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - sent).max()
            sent = 0.5 * sent + 0.5 * new
            if moved < 1e-3:
                break
        belief = unary.copy()
        np.add.at(belief, target, sent)
        return belief

    def added(self, text: str | None, base: list[Span], add_at: float = ADD_AT) -> list[Span]:
        """Spans that the patterns did not find; tokens of one number that stand side by side are one span."""
        tokens = candidates(text, base)
        if not tokens or all(t.label for t in tokens):
            return []
        p = self.marginals(tokens)
        out: list[list[int]] = []
        before = -2
        for token, label, sure in zip(tokens, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
            if not label or token.label or sure < add_at:
                continue
            if out and out[-1][0] == label - 1 >= 2 and token.place == before + 1:
                out[-1][2] = token.end
            else:
                out.append([label - 1, token.start, token.end])
            before = token.place
        return [tuple(s) for s in out]


def _logs(counts: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
    return np.log((counts + weight * prior) / (counts.sum() + weight))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Crf:
    """Train the field on at most about ``fit_rows`` documents that have candidate tokens."""
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    total = rows.select("doc_id").count()
    if total > fit_rows:
        share = int(fit_rows / total * (1 << 31))
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 31)) < share)

    def work(batch):
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            tokens = candidates(text, base_spans(text))
            counts.update(("u", shape(t.text), t.label, 0) for t in tokens)
            counts.update(("cs"[s], "", tokens[i].label, tokens[j].label) for i, j, s in edges(tokens))
        return [[k[i] for k in counts] for i in range(4)] + [list(counts.values())]

    schema = "what string, shape string, one int, two int, n bigint"
    counted = over_batches(rows, work, schema).groupBy("what", "shape", "one", "two").agg(F.sum("n").alias("n"))
    pairs, labels, by_shape = np.zeros((2, LABELS, LABELS)), np.zeros(LABELS), {}
    for r in counted.orderBy(F.col("what") == "u", F.col("n").desc(), "shape", "one").limit(SHAPES).collect():
        if r["what"] == "u":
            by_shape.setdefault(r["shape"], np.zeros(LABELS))[r["one"]] += r["n"]
            labels[r["one"]] += r["n"]
        else:
            pairs["cs".index(r["what"]), r["one"], r["two"]] += r["n"]
    if not labels.any():
        return Crf()
    prior = np.array([0.98] + [0.02 / len(KINDS)] * len(KINDS))
    unary = {s: _logs(c, prior, 2.0).tolist() for s, c in by_shape.items()}
    out = []
    for counts, agree in zip(pairs, (0.0, 0.5)):  # linked tokens are taken to agree until counts say otherwise
        both = counts + counts.T + 0.05 + agree * np.eye(LABELS)
        rest = both / both.sum()
        out.append(np.clip(np.log(rest / np.outer(rest.sum(axis=1), rest.sum(axis=0))), -4.0, 4.0).tolist())
    return Crf(unary, np.log(prior).tolist(), out)


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_entities(docs: DataFrame, crf: Crf, add_at: float = ADD_AT) -> DataFrame:
    """(doc_id, base, added) per row; spans are (kind, start, end) in code points, end exclusive."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"

    def rows_of(found):
        return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in found]

    def work(batch):
        bases, more = [], []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            bases.append(rows_of(base))
            more.append(rows_of(crf.added(text, base, add_at)))
        return [batch.column(0), bases, more]

    return over_batches(docs.select("doc_id", "text"), work, f"doc_id {kind}, base {spans}, added {spans}")


def redact(docs: DataFrame, crf: Crf, add_at: float = ADD_AT) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars`` counted anew where it changed."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at, length = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def replaced(text):
        base = base_spans(text)
        spans = sorted([*base, *crf.added(text, base, add_at)], key=lambda s: (s[1], -s[2]))
        out, end = [], 0
        for kind, a, b in spans:
            if a >= end:
                out += [text[end:a], f"[{KINDS[kind].upper()}]"]
            end = max(end, b)
        return "".join([*out, text[end:]]) if spans else text

    def work(batch):
        columns = list(batch.columns)
        before = columns[at].to_pylist()
        columns[at] = [replaced(t) for t in before]
        if length is not None:
            counts = columns[length].to_pylist()
            columns[length] = [n if a == b else len(b) for n, a, b in zip(counts, before, columns[at])]
        return columns

    return over_batches(docs, work, schema)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_entities(docs, fit(docs))

    def joined(spans):
        rank = F.array(*map(F.lit, KINDS))
        keyed = F.transform(
            spans, lambda s: F.struct(s["start"], F.array_position(rank, s["kind"]).alias("rank"), s["end"], s["kind"])
        )
        parts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def counted(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
    )
