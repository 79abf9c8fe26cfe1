"""Main text of web pages by consensus of their host.

Each page's containers are scored: long text in few links counts for a container, names of menus,
adverts, comments and the like count against it, and so does what lies in another container's
side. A page votes for the tag-class path of its best container, in which numbers and hexadecimal names are generalised;
votes are summed per host in Spark, and every page of the host is extracted again from the container that stands at the
host's winning path. A page that has nothing there uses its own best container.

Text: character references are decoded, white space inside a block becomes one space, blocks are
joined by line feeds in page order. Navigation, headers, footers, sidebars, forms, notices, adverts,
comments, scripts and styles are left out wherever they stand; nothing else is.

Defined results: null and empty html has the empty text. A null or odd url is of the host "". Ties
between paths: more pages, then the path's order. Repeated rows vote as often as they occur and
give one result each. An empty table gives no rows. Other columns are not read.

Scale: votes are summed on the map side, so a hot host shuffles a few rows per task. Winners are one
row per host. To join them, pages of a host with more than ``TASK_PAGES`` of them are dealt over as many keys
as it takes to keep to that number, so a task's share of a host doesn't grow with the table. The list of such hosts has
``HOT_HOSTS`` entries at most, the largest, so it may be broadcast; any other host has less than a
thousandth of all pages, and adaptive execution may still split it.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.session import stage

from .common import over_batches, table

TASK_PAGES = 2_000
HOT_HOSTS = 1_000
DEPTH = 12  # steps of a path that are written out, from the container upwards

# Elements without content, with raw content, and those that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body center".split())
CLOSES_P = BLOCKS - {"head", "html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
# start tag: open elements of these names that it ends, up to the nearest of the second set
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
# Elements, roles and words of class or id whose content is never main text.
LEFT_OUT = frozenset("nav footer aside form script style noscript iframe button select textarea input template svg canvas object head menu dialog title".split())
LEFT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_BAD_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|disqus|cookies?|consent|gdpr|footer|header|masthead|menus?|nav\w*|"
    r"newsletter|notices?|popup|modal|promo\w*|related|share|sharing|sidebar|side-?bar|social|sponsor\w*|subscribe|toolbar|widgets?|skip|login|signup)(?:$|[-_\s])",
    re.IGNORECASE,
)
_NUMBERED = re.compile(r"(?<![a-z0-9])(?=[a-f]*[0-9])[0-9a-f]{6,}(?![a-z0-9])|[0-9]+")
_TAG = re.compile(r"<!--|<!\[CDATA\[|<[!?]|</?[A-Za-z]")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_TAG_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")


@dataclass
class Node:
    tag: str
    parent: int
    name: str  # class and id
    left_out: bool
    children: list = field(default_factory=list)  # of texts and node numbers
    trail: str = ""


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def parse(html: str | None) -> list[Node]:
    """The page's elements; the first is the root. Every text ends somewhere, however broken the markup."""
    html = html or ""
    nodes, stack = [Node("", -1, "", False)], [0]
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a name, the innermost last

    def text(a: int, b: int) -> None:
        if b > a:
            nodes[stack[-1]].children.append(html[a:b])

    def close(names, limits) -> None:
        """End the innermost open element of these names, unless one of the limits is nearer."""
        depth = max((places[-1] for n in names if (places := open_at.get(n))), default=0)
        if depth and depth > max((places[-1] for n in limits if (places := open_at.get(n))), default=0):
            for number in stack[depth:]:
                open_at[nodes[number].tag].pop()
            del stack[depth:]

    at, length = 0, len(html)
    while at < length:
        found = _TAG.search(html, at)
        if not found:
            text(at, length)
            break
        start = found.start()
        text(at, start)
        opening = found.group()
        if opening in ("<!--", "<![CDATA["):
            end = html.find("-->" if opening == "<!--" else "]]>", found.end())
            if opening != "<!--":
                text(found.end(), end if end >= 0 else length)
            at = end + 3 if end >= 0 else length
            continue
        if opening in ("<!", "<?"):
            end = html.find(">", start)
            at = end + 1 if end >= 0 else length
            continue
        name = _NAME.match(html, found.end() - 1)
        end = _TAG_END.match(html, name.end())
        stop = end.end() if end else html.find(">", name.end()) + 1 or length
        tag = name.group().lower()
        if opening[1] == "/":
            if tag not in VOID:
                # an end tag in a table cell does not end what is open around the table
                close({tag}, set() if tag in ("table", "body", "html") else {"table"})
            at = stop
            continue
        inner = html[name.end() : stop - 1]
        if tag in CLOSES_P:
            close({"p"}, BLOCKS - {"p"})
        if tag in IMPLIED:
            names, limits = IMPLIED[tag]
            close(names, limits)
        given = _attributes(inner) if "=" in inner else {}
        label = f"{given.get('class', '')} {given.get('id', '')}".strip()
        out = (
            tag in LEFT_OUT
            or given.get("role", "").lower() in LEFT_ROLES
            or bool(label and tag not in ("body", "html", "article", "main") and _BAD_NAME.search(label))
            or "hidden" in inner.split()
            or given.get("aria-hidden", "").lower() == "true"
        )
        nodes.append(Node(tag, stack[-1], label, out))
        number = len(nodes) - 1
        nodes[stack[-1]].children.append(number)
        at = stop
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
            a = closing.start() if closing else length
            nodes[number].children.append(html[at:a])
            after = html.find(">", a)
            at = after + 1 if closing and after >= 0 else length
        elif tag not in VOID and not (inner.endswith("/") and tag in ("svg", "path")):
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(number)
    return nodes


def _step(node: Node) -> str:
    """Tag and classes; numbers and long hexadecimal names, which differ from page to page, are all one."""
    classes = ".".join(sorted({_NUMBERED.sub("#", name) for name in node.name.lower().split()}))
    return f"{node.tag}.{classes}" if classes else node.tag


def _trail(nodes: list[Node], number: int) -> str:
    """A digest of all steps down to an element."""
    chain = []
    while number > 0 and not nodes[number].trail:
        chain.append(number)
        number = nodes[number].parent
    trail = nodes[number].trail
    for number in reversed(chain):
        trail = nodes[number].trail = hashlib.sha256(f"{trail}>{_step(nodes[number])}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return trail


def path_of(nodes: list[Node], number: int) -> str:
    """The steps from the root; of a deep element's upper ones a digest."""
    steps = []
    while number > 0 and len(steps) < DEPTH:
        steps.append(_step(nodes[number]))
        number = nodes[number].parent
    if number > 0:
        steps.append("~" + _trail(nodes, number))
    return ">".join(reversed(steps))


def _left_out(nodes: list[Node], number: int, container: int) -> bool:
    """Headers go too, but for one in the container that has the page's heading."""
    node = nodes[number]
    if node.tag == "header" and not node.left_out:
        return not (container > 0 and any(nodes[c].tag == "h1" for c in node.children if isinstance(c, int)))
    return node.left_out


def best_container(nodes: list[Node]) -> int:
    """The container with the highest score; the root if there is none."""
    count = len(nodes)
    chars, linked = [0] * count, [0] * count
    own = [0] * count  # characters of paragraphs and headings right in the element
    out = [False] * count
    in_link = [False] * count
    for n in range(1, count):
        node = nodes[n]
        out[n] = out[node.parent] or node.left_out or node.tag == "header"
        in_link[n] = in_link[node.parent] or node.tag == "a"
    for n in range(count - 1, -1, -1):
        node = nodes[n]
        if not out[n]:
            direct = sum(len(c.split()) and len(" ".join(c.split())) for c in node.children if isinstance(c, str))
            chars[n] += direct
            linked[n] += direct if in_link[n] else 0
        if n:
            parent = node.parent
            chars[parent] += chars[n]
            linked[parent] += linked[n]
            if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "table", "figure"):
                own[parent] += chars[n]
            elif node.tag not in BLOCKS:
                own[parent] += own[n]
    best, top = 0, 0.0
    for n in range(1, count):
        node = nodes[n]
        if node.tag not in CONTAINERS or out[n] or not chars[n]:
            continue
        # text that stands right in the container counts whole, what lies in inner containers a little
        score = (own[n] + 0.1 * (chars[n] - own[n]) + 1.0) * (1 - linked[n] / chars[n]) ** 2
        if node.tag in ("article", "main"):
            score *= 3
        if score > top:
            best, top = n, score
    return best


def at_path(nodes: list[Node], path: str) -> list[int]:
    """The outermost elements at a path, in page order."""
    last = path.rpartition(">")[2]
    out, ends = [], set()
    for n in range(1, len(nodes)):
        parent = nodes[n].parent
        if parent in ends:
            ends.add(n)
        elif _step(nodes[n]) == last and path_of(nodes, n) == path:
            out.append(n)
            ends.add(n)
    return out


def text_of(nodes: list[Node], containers: list[int]) -> str:
    """The blocks of the containers, one per line."""
    blocks: list[str] = []
    open_block: list[str] = []

    def end_block():
        if open_block:
            line = " ".join(entities.unescape("".join(open_block)).split())
            if line:
                blocks.append(line)
            open_block.clear()

    for container in containers:
        todo: list = [container]
        while todo:
            item = todo.pop()
            if item is None:
                end_block()
            elif isinstance(item, str):
                open_block.append(item)
            else:
                node = nodes[item]
                if item != container and _left_out(nodes, item, container) or node.tag in RAW:
                    if node.tag in BLOCKS:
                        end_block()
                    continue
                if node.tag in BLOCKS:
                    end_block()
                    todo.append(None)
                elif node.tag == "br":
                    open_block.append(" ")
                todo += reversed(node.children)
        end_block()
    return "\n".join(blocks)


def extract(html: str | None, path: str | None) -> str:
    """Main text of a page, from the container at ``path`` or else from the page's own best one."""
    nodes = parse(html)
    containers = [n for n in at_path(nodes, path) if text_of(nodes, [n])] if path else []
    return text_of(nodes, containers or [best_container(nodes)])


def host_of(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, pages): how many pages of a host have their best container at a path."""

    def work(batch):
        paths = []
        for html in batch.column(1).to_pylist():
            nodes = parse(html)
            paths.append(path_of(nodes, best_container(nodes)))
        return [batch.column(0), paths]

    best = over_batches(pages.select(host_of("url").alias("host"), F.col("html").cast("string")), work, "host string, path string")
    return best.filter("path <> ''").groupBy("host", "path").agg(F.count("*").alias("pages"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, path): the path with most pages."""
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("pages")).alias("n"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def hot_hosts(counted: DataFrame, task_pages: int, most: int) -> DataFrame:
    """(host, salts) of the hosts with more than ``task_pages`` pages, the ``most`` largest at most."""
    large = counted.groupBy("host").agg(F.sum("pages").alias("n")).filter(F.col("n") > task_pages)
    large = large.orderBy(F.col("n").desc(), "host").limit(most)
    return large.select("host", F.ceil(F.col("n") / task_pages).cast("int").alias("salts"))


def main_texts(pages: DataFrame, task_pages: int = TASK_PAGES, most_hot: int = HOT_HOSTS) -> DataFrame:
    """(page_id, url, text) per row of ``pages``."""
    counted = stage(votes(pages), "votes")
    hot = F.broadcast(stage(hot_hosts(counted, task_pages, most_hot), "hot"))
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    won = winners(counted).join(hot, "host", "left").select("host", "path", spread.alias("salt"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of("url").alias("host"))
    rows = rows.join(hot, "host", "left")
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "html"), "salts").cast("int"), F.lit(0)))
    joined = rows.join(won, ["host", "salt"], "left").select("page_id", "url", "html", "path")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))

    def work(batch):
        texts = [extract(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return [batch.column(0), batch.column(1), texts]

    return over_batches(joined, work, f"{kinds}, text string")


def op10_html(spark, sf_dir: str) -> DataFrame:
    texts = main_texts(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
