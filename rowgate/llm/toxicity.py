"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read the words of a clause from left to right and are composed: their product runs as one machine, whose
state is the tuple of theirs.

- insult: a trie acceptor of word beginnings, learned from labelled rows. The last accepting
  state that a word passes gives its weight, so one state accepts all inflections of a stem.
- threat: a modal, then a verb of harm, then a person as its object, each at most ``REACH`` words behind the one before. What
  the addressee will do ("you will beat them") is no threat, and neither is harm to things.
- target: someone is addressed at most ``REACH`` words before, or right behind; possessives address nobody.
- negation: words that turn an insult or threat around if they stand within ``REACH`` words before it.
- reported speech: quotation marks, or verbs of saying before it.

The composition gives at most one match per insult or threat, of a kind that says what surrounds it: plain, at a target, negated
or reported. A document is scored by its matched clauses: a logistic model over, per kind, the weight of matches (log scale, and as
a rate per clause). No word decides alone: plain matches count only beside those of another clause (the heaviest clause's own are
left out), so a text in which one clause has such words is like one without, unless they are said to someone. Texts without any match
get the model's base rate. Where no labelled row has an insult at a target, it weighs what plain ones do.

Beginnings are kept with their log ratio shrunk towards none. How much evidence they must have (``ROOTS``) is
chosen by the labels: rows are dealt into folds, each is matched by beginnings learned from the other
folds, and the model is fitted to these matches; the bar of the least loss is taken. So chance words of few labels
get little weight. Threats need no learned word: where no labelled row holds one, one threat to a person makes a text toxic.

The acceptor's weights and the model are fitted on at most ``FIT_ROWS`` labelled rows (chosen by
a hash of the id), never on rows held out. Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts have no clause and get the base rate. A null doc_id is
held out (its remainder is unknown) and is scored. Rows are never grouped, so repeated rows are
scored alike. Labels of unknown documents and null labels are not used; of contradicting
labels of one text the toxic one counts. Without a usable label of either kind only threats count.

Scale: fitting reads the labelled rows once and brings at most ``FIT_ROWS`` short rows of matches to
the driver; scoring is one pass without a shuffle, with a model of at most ``STEMS`` stems sent along.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import encoded, over_batches, table

FIT_ROWS = 20_000
STEMS = 2_000
STEM_LETTERS = (3, 12)
# A beginning accepts if its odds of toxic rows, drawn to those of all rows by a prior that weighs like
# PRIOR_ROWS rows, are at least this many times as large, and if it stands in two toxic rows: one cannot be tested on another.
LEAST_RATIO = 2.0
PRIOR_ROWS = 4.0
# Bars for the root of its likelihood ratio, of which the labels choose; none of a million unrelated beginnings reaches the last.
ROOTS = (0.0, 3.0, 4.5, 6.0)
FOLDS = 4
# Log odds of a text with one threat, where labels say nothing of threats.
THREAT = 1.0
REACH = 3
REJECT_AT = 0.5

# Function words of the four languages of the corpus (en, de, fr, es).
TARGETS = frozenset("you you're u ya du dich dir ihr euch tu te toi vous tú ti usted ustedes vos".split())
PERSONS = TARGETS | frozenset("him her them us me everyone everybody anyone someone ihn ihm ihnen uns mich mir jeden lui leur nous moi ellos ellas nosotros".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nobody nicht kein keine nie niemals pas jamais aucun ne nunca jamás ningún".split())
REPORTS = frozenset("said says say wrote writes called calls quoted claimed told sagte sagt schrieb nannte dit dite écrit appelé dijo dice escribió llamó".split())
MODALS = frozenset("will shall gonna going i'll we'll must should werde werden wird muss vais va doit voy vamos debe".split())
HARMS = ("kill", "hurt", "destroy", "murder", "shoot", "beat", "töte", "schlag", "vernicht", "tuer", "frapp", "détrui", "matar", "golpe", "destru")
KINDS = ("plain", "targeted", "negated", "reported", "threat")

_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
_QUOTES = frozenset('"“”«»')


@dataclass
class Model:
    """Weights of accepting beginnings, and the logistic model over kinds of matches."""

    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * 4 + [(THREAT + 20.0) / math.log(2)] + [0.0] * len(KINDS))
    base: float = -20.0


def clauses(text: str | None) -> list[list[str]]:
    return [t for c in _CLAUSE.split((text or "").lower()) if (t := _TOKEN.findall(c))]


class Transducer:
    """States, and arcs (state, class of word) -> (state, output); the first class with an arc is taken.

    ``default`` gives the arc of words without one. An output is None or a weight.
    """

    def __init__(self, start, arcs: dict, default: dict):
        self.start, self.arcs, self.default = start, arcs, default

    def step(self, state, classes: tuple[str, ...]):
        for name in classes:
            arc = self.arcs.get((state, name))
            if arc is not None:
                return arc
        return self.default[state]


def _reaching(name: str) -> Transducer:
    """Gives 1 for a word of the class ``name`` and for each of the ``REACH`` words behind it."""
    arcs = {(k, name): (REACH, 1.0) for k in range(REACH + 1)}
    return Transducer(0, arcs, {0: (0, None), **{k: (k - 1, 1.0) for k in range(1, REACH + 1)}})


def _speech() -> Transducer:
    """Gives 1 inside quotation marks and from a verb of saying on."""
    arcs = {("plain", "quote"): ("quoted", 1.0), ("quoted", "quote"): ("plain", None)}
    arcs |= {(state, "report"): ("said", 1.0) for state in ("plain", "quoted", "said")}
    return Transducer("plain", arcs, {"plain": ("plain", None), "quoted": ("quoted", 1.0), "said": ("said", 1.0)})


def _threat() -> Transducer:
    """Gives 1 at the person who is the object of a verb of harm behind a modal."""
    arcs, default = {}, {"idle": ("idle", None), "you": ("idle", None)}
    states = ["idle", "you", *((step, k) for step in ("can", "harm") for k in range(1, REACH + 1))]
    for state in states:
        if state != "you":  # not what the addressee can do
            arcs[state, "modal"] = ("can", REACH), None
        if state in ("idle", "you"):
            arcs[state, "target"] = "you", None
        elif state[0] == "can":
            arcs[state, "harm"] = ("harm", REACH), None
        else:
            arcs[state, "person"] = "idle", 1.0
        if state not in default:
            default[state] = ((state[0], state[1] - 1) if state[1] > 1 else "idle"), None
    return Transducer("idle", arcs, default)


SPEECH, NEGATION, TARGET, THREATS = _speech(), _reaching("negation"), _reaching("target"), _threat()
COMPOSED = (SPEECH, NEGATION, TARGET, THREATS)
_CLASSES = (("quote", _QUOTES), ("report", REPORTS), ("modal", MODALS), ("negation", NEGATIONS), ("target", TARGETS), ("person", PERSONS))


def classes_of(word: str) -> tuple[str, ...]:
    """The classes that transducers read, but for insults, which are the trie's."""
    found = [name for name, words in _CLASSES if word in words]
    return (*found, "harm") if word.startswith(HARMS) else tuple(found)


class Grammar:
    """The composed transducers over the stems of a model."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        sizes = sorted({len(s) for s in stems}, reverse=True)
        self.sizes = sizes
        self.known: dict[str, tuple[float, tuple[str, ...]]] = {}
        # product state -> class -> (product state, outputs); made as states are met, of which there are few hundred
        self.arcs: dict[tuple, dict] = {}

    def weight(self, word: str) -> float:
        """Of the last accepting state that the word passes; 0 if it passes none."""
        found = 0.0
        for size in self.sizes:
            if size <= len(word) and (found := self.stems.get(word[:size], 0.0)):
                break
        return found

    def read(self, word: str) -> tuple[float, tuple[str, ...]]:
        """A word's weight and classes."""
        found = self.known.get(word)
        if found is None:
            found = self.weight(word), classes_of(word)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def step(self, state: tuple, classes: tuple[str, ...]) -> tuple[tuple, tuple]:
        arcs = self.arcs.setdefault(state, {})
        found = arcs.get(classes)
        if found is None:
            steps = [t.step(s, classes) for t, s in zip(COMPOSED, state)]
            found = arcs[classes] = tuple(s for s, _ in steps), tuple(o for _, o in steps)
        return found

    def match(self, clause: list[str]) -> list[tuple[int, float]]:
        """(kind, weight) of each match of a clause: insults first, then threats."""
        read = [self.read(word) for word in clause]
        if not any(w or "harm" in c for w, c in read):
            return []
        state, insults, threats = tuple(t.start for t in COMPOSED), [], []
        for at, (weight, classes) in enumerate(read):
            state, (speech, negated, target, threat) = self.step(state, classes)
            if weight:
                # who is addressed right behind is only read next
                near = target or at + 1 < len(read) and "target" in read[at + 1][1]
                insults.append((3 if speech else 2 if negated else 1 if near else 0, weight))
            if threat and not speech and not negated:
                threats.append((4, threat))
        return insults + threats

    def features(self, text: str | None) -> list[float]:
        """Per kind the log of the summed weight, then per kind the summed weight per clause."""
        sums, count, heaviest = [0.0] * len(KINDS), 0, 0.0
        for clause in clauses(text):
            count += 1
            plain = sums[0]
            for kind, weight in self.match(clause):
                sums[kind] += weight
            heaviest = max(heaviest, sums[0] - plain)
        return _features(sums, count, heaviest)


def _features(sums: list[float], count: int, heaviest: float) -> list[float]:
    """Of plain matches those of the heaviest clause are left out."""
    sums = [max(0.0, sums[0] - heaviest), *sums[1:]]
    return [math.log1p(s) for s in sums] + [s / max(count, 1) for s in sums]


class Folded:
    """The grammar of the beginnings learned without a fold: features for every bar of ``ROOTS``."""

    def __init__(self, learned: list[tuple[str, float, float]]):
        self.learned = learned
        self.grammar = Grammar({start: at + 1 for at, (start, _, _) in enumerate(learned)})

    def features(self, text: str | None) -> list[float]:
        sums, count, heaviest = [[0.0] * len(KINDS) for _ in ROOTS], 0, [0.0] * len(ROOTS)
        for clause in clauses(text):
            count += 1
            plain = [of_bar[0] for of_bar in sums]
            for kind, found in self.grammar.match(clause):
                _, weight, ratio = ("", 1.0, math.inf) if KINDS[kind] == "threat" else self.learned[int(found) - 1]
                for of_bar, root in zip(sums, ROOTS):
                    if ratio > root**2:
                        of_bar[kind] += weight
            heaviest = [max(h, of_bar[0] - p) for h, of_bar, p in zip(heaviest, sums, plain)]
        return [f for of_bar, h in zip(sums, heaviest) for f in _features(of_bar, count, h)]


def held_out(doc_id: Column | str) -> Column:
    remainder = F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, "UTF-8")) % 5
    return F.coalesce(remainder == 0, F.lit(True))


def beginnings(text: str | None) -> set[str]:
    """All beginnings of the text's words, each once."""
    low, high = STEM_LETTERS
    words = {w for c in clauses(text) for w in c}
    return {w[:k] for w in words for k in range(low, min(len(w), high) + 1)}


def _sampled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """At most about ``fit_rows`` labelled rows (text, toxic) that aren't held out."""
    usable = labels.filter("toxic IS NOT NULL").filter(~held_out("doc_id"))
    rows = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = rows.count()
    if total > fit_rows:
        share = int(fit_rows / total * (1 << 31))
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < share)
    # one row per id and about fit_rows of them: small enough to send to every task, so no text is shuffled
    return _examples(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id"))


def _examples(rows: DataFrame) -> DataFrame:
    """(text, toxic): copies and most near copies are one example, as they would prove chance words.

    Rows that share the smallest hash of a run of words are one, for either of two hashes.
    """

    def work(batch):
        texts = batch.column("text").to_pylist()
        seeds = [[], []]
        for text in texts:
            words = encoded(text).lower().split()
            runs = {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
            for seed, out in enumerate(seeds):
                out.append(min(xxhash.xxh3_64_intdigest(r, seed) for r in runs) >> 1)
        return [texts, batch.column("toxic"), *seeds]

    out = over_batches(rows.select("text", "toxic"), work, "text string, toxic int, one bigint, two bigint")
    for key in ("one", "two"):
        out = out.groupBy(key).agg(F.max(F.struct("toxic", "text", "one", "two")).alias("r")).select("r.*")
    return out.select("text", "toxic")


def _chosen(scored: DataFrame, stems: int) -> list[tuple[str, float, float]]:
    """(start, weight, ratio), best first; none is the beginning of another, so those above a bar are a head of the list."""
    # of equally good beginnings the longest: it accepts least besides
    order = (F.col("ratio").desc(), F.length("start").desc(), F.col("start"))
    chosen: dict[str, tuple] = {}
    above: set[str] = set()
    for row in scored.orderBy(*order).limit(8 * stems).collect():
        start = row["start"]
        below_chosen = any(start[:k] in chosen for k in range(1, len(start)))
        if start not in above and not below_chosen and len(chosen) < stems:
            chosen[start] = start, row["w"], row["ratio"]
            above.update(start[:k] for k in range(1, len(start)))
    return list(chosen.values())


def learn_stems(rows: DataFrame, stems: int = STEMS) -> list[list[tuple[str, float, float]]]:
    """Accepting beginnings with weight and ratio: learned without each fold, and last from all rows.

    rows: text, toxic, fold. All are counted in Spark at once.
    """

    def work(batch):
        out = ([], [], [])
        for text, *of in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic", "fold"))):
            starts = beginnings(text)
            out[0].extend(starts)
            for column, value in zip(out[1:], of):
                column.extend([value] * len(starts))
        return list(out)

    def counts(df):
        of = [F.when(F.col("fold") == k, 1).otherwise(0) for k in range(FOLDS)]
        return df.agg(*[F.sum(m * t).alias(f"{n}{k}") for k, m in enumerate(of) for n, t in (("b", F.col("toxic")), ("n", F.lit(1)))])

    totals = counts(rows.groupBy()).first()
    whole = over_batches(rows.select("text", "toxic", "fold"), work, "start string, toxic int, fold int")
    twice = sum((F.col(f"b{k}") for k in range(FOLDS)), F.lit(0)) >= 2
    counted = None
    learned = []
    for left in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != left]
        bad = sum(totals[f"b{k}"] or 0 for k in folds)
        good = sum(totals[f"n{k}"] or 0 for k in folds) - bad
        if not bad or not good:
            learned.append([])
            continue
        if counted is None:
            counted = stage(counts(whole.groupBy("start")).filter(twice), "beginnings")
        b, n = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in "bn")
        able = counted.select("start", b.alias("b"), n.alias("n")).filter("b >= 2")
        g, share = F.col("n") - F.col("b"), bad / (bad + good)
        part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(F.lit(0.0))
        ratio = 2 * (part(F.col("b"), F.col("n") * share) + part(g, F.col("n") * (1 - share)))
        odds = (F.col("b") + PRIOR_ROWS * share) / (g + PRIOR_ROWS * (1 - share)) * ((1 - share) / share)
        scored = able.select("start", F.log(odds).alias("w"), ratio.alias("ratio")).filter(F.col("w") > math.log(LEAST_RATIO))
        learned.append(_chosen(scored, stems))
    return learned


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and base, and the loss, of a ridge logistic model, by Newton steps that are halved until the loss falls."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[x.std(axis=0) == 0] = np.inf  # a kind that never occurs gets no weight
    z = np.column_stack([x / scale, np.ones(len(x))])
    penalty = np.array([ridge] * x.shape[1] + [1e-4])
    w = np.zeros(z.shape[1])

    def loss(v):
        m = z @ v
        return (np.logaddexp(0, m) - y * m).sum() + 0.5 * (penalty * v * v).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.concatenate([w[:-1] / scale, w[-1:]]), loss(w)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, stems: int = STEMS) -> Model:
    """Learn the insult acceptor and the model of match kinds from rows that aren't held out."""
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = stage(_sampled(docs, labels, fit_rows).select("text", "toxic", fold), "labelled")
    *without, learned = learn_stems(rows, stems)
    grammars = [Folded(of) for of in without]

    def work(batch):
        texts, folds = batch.column("text").to_pylist(), batch.column("fold").to_pylist()
        return [[grammars[k].features(t) for t, k in zip(texts, folds)], [1 if t else 0 for t in batch.column("toxic").to_pylist()]]

    seen = over_batches(rows, work, "f array<double>, y int").groupBy("f", "y").count().collect()
    seen.sort(key=lambda r: (r["f"], r["y"]))
    if len({r["y"] for r in seen}) < 2 or not any(any(r["f"]) for r in seen):
        return Model()
    times = [r["count"] for r in seen]
    x, y = np.repeat([r["f"] for r in seen], times, axis=0), np.repeat([r["y"] for r in seen], times)
    size = 2 * len(KINDS)
    fitted = [(*fit_logistic(x[:, k * size : (k + 1) * size], y), k) for k in range(len(ROOTS))]
    w, _, bar = min(reversed(fitted), key=lambda f: f[1])  # of equal losses the highest bar
    weights, base, threat = w[:-1].tolist(), float(w[-1]), KINDS.index("threat")
    if not x[:, threat].any():
        weights[threat] = (THREAT - base) / math.log(2)
    targeted, plain = x[:, bar * size + 1], weights[0]
    if not targeted.any():
        weights[1] = max(weights[1], plain)
    return Model({start: weight for start, weight, ratio in learned if ratio > ROOTS[bar] ** 2}, weights, base)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores between 0 and 1."""
    if name in docs.columns:
        raise ValueError(f"docs already has a column {name}")
    grammar = Grammar(model.stems)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index("text")

    def work(batch):
        out = []
        for text in batch.column(at).to_pylist():
            z = model.base + sum(w * f for w, f in zip(model.weights, grammar.features(text)))
            out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))
        return [*batch.columns, out]

    return over_batches(docs, work, f"{schema}, `{name}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """``docs`` without the documents that score ``reject_at`` or more."""
    scored = score(docs, fit(docs, labels), "__score")
    return scored.filter(F.col("__score") < reject_at).drop("__score")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
