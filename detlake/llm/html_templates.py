"""Main text of web pages: equivalence classes of template tokens per host, their nesting, and the slot with the article."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import per_batch, present

# Elements by what they mean for reading.
CONTAINERS = frozenset("html body main article section div table tbody thead tfoot tr td th center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre hr figure figcaption caption address details summary".split())
#: Never part of the article, with all they hold.
ASIDE = frozenset("nav header footer aside form menu dialog button select option noscript template iframe object svg canvas head".split())
#: Their content is not markup.
RAW = ("script", "style", "textarea", "title", "xmp", "noembed", "noframes")
#: Words of class, id or role attributes that mark menus, notices, adverts, sharing and reader comments.
SIGNS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr nav navbar "
    "navigation menu breadcrumb breadcrumbs header footer sidebar aside related recommended share sharing social newsletter subscribe "
    "signup login popup modal overlay alert comment comments reply replies respond discussion disqus widget toolbar pagination pager "
    "complementary contentinfo".split()
)

#: Their ids name what the text is about, not a part of the page.
TITLED = frozenset("p h1 h2 h3 h4 h5 h6 dt span".split())
LISTS = frozenset("ul ol dl".split())

# A comment, a declaration, or a tag with its attributes. Nothing is tried twice: a tag whose end is not found matches without its ">".
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>?)", re.S)
_LOOSE = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>?)", re.S)
_CLOSERS = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_ARTICLES = re.compile(r"<(?:article|main)\b", re.I)
_FORM_ENDS = re.compile(r"</form\b", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PIECE = re.compile(r"[a-zA-Z]+")


def _signature(tag: str, attributes: str) -> tuple[str, bool]:
    """Role of an element among its siblings, and whether it is marked as no part of the article."""
    if tag in ASIDE:
        return tag, True
    names, off, seen = [], False, set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        kind, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if kind in seen:  # the first of a name counts
            continue
        seen.add(kind)
        if kind == "hidden" or kind == "aria-hidden" and value.strip().lower() == "true":
            off |= tag not in ("html", "body")
        elif kind in ("class", "role") or kind == "id" and tag not in TITLED:
            off |= tag not in ("html", "body", "main", "article") and not SIGNS.isdisjoint(w.lower() for w in _PIECE.findall(value))
        if kind in ("class", "id"):
            names.append(value)
    # numbers differ from page to page and are no part of a role
    return tag + "".join("." + re.sub(r"\d+", "N", n) for n in names), off


def _ends(tag: str, names: list[str]) -> int:
    """How many of the open elements end where a block ``tag`` starts: an open paragraph, and the item before an item, with what they hold."""
    n = 0
    for k, name in enumerate(reversed(names), 1):
        if name == "p" or name == tag == "li" or name in ("dt", "dd") and tag in ("dt", "dd"):
            n = k
        elif name in LISTS or name in ASIDE or name in CONTAINERS and (name != "div" or tag not in ("li", "dt", "dd")):
            break
        elif name in BLOCKS and tag not in ("li", "dt", "dd"):
            break
    return n


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """``(start, end, closing, tag, attributes)`` of every tag; comments, declarations and raw elements come without a tag.

    Each character is looked at a bounded number of times. A tag that never ends because a quote stays open ends at its first ">", and from
    there on quotes are not heeded; without any ">" it is text. Raw elements without an end reach to the end of the page.
    """
    at, pattern = 0, _TOKEN
    while m := pattern.search(page, at):
        start, tag = m.start(), m[2]
        if tag is None:
            closer = _CLOSERS[m[0]]
            e = page.find(closer, m.end())
            at = len(page) if e < 0 else e + len(closer)
            yield start, at, False, "", ""
            continue
        attributes, at = m[3], m.end()
        if not m[4]:
            e, pattern = page.find(">", m.end(2)), _LOOSE
            if e < 0:
                return
            attributes, at = page[m.end(2) : e], e + 1
        tag = tag.lower()
        if tag in _RAW_ENDS and not m[1]:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            tag = ""
        yield start, at, bool(m[1]), tag, attributes


def _holds_article(page: str) -> Callable[[int], bool]:
    """Whether a form that begins at a place has an article or main element before its end."""
    articles, ends = ([m.start() for m in p.finditer(page)] for p in (_ARTICLES, _FORM_ENDS))

    def holds(at: int) -> bool:
        first, end = bisect_right(articles, at), bisect_right(ends, at)
        return first < len(articles) and (end == len(ends) or articles[first] < ends[end])

    return holds


#: Characters of a path; what lies above in longer ones is replaced by its hash, so that deep pages stay small.
PATH = 4000


def _below(path: str, role: str) -> str:
    if len(path) + len(role) >= PATH:
        path = "/" + xxhash.xxh3_64_hexdigest(path)
    return f"{path}/{role}"


def blocks(page: str) -> tuple[list[tuple[int, str]], list[tuple[str, int, bool]]]:
    """Text blocks in page order, each with its container, and the containers: path, parent and whether it is set aside.

    Container 0 is the page itself. End tags close all containers inside; end tags without a start are ignored, and what is
    never closed ends with its parent, a paragraph or item that is set aside also where the next block or item starts.
    """
    tree: list[tuple[str, int, bool]] = [("", -1, False)]
    stack, names = [0], [""]
    out: list[tuple[int, str]] = []
    held: list[str] = []

    opened: Counter[str] = Counter(names)

    def push(container: int, tag: str) -> None:
        stack.append(container)
        names.append(tag)
        opened[tag] += 1

    def drop(n: int) -> None:
        opened.subtract(names[-n:])
        del stack[-n:], names[-n:]

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text and not tree[stack[-1]][2]:
                out.append((stack[-1], text))

    at, holds = 0, None
    for start, end, closing, tag, attributes in tags(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "form":
            holds = holds or _holds_article(page)
            if not closing and holds(start) or closing and not opened[tag]:
                flush()
                continue
        if tag not in BLOCKS and tag not in ASIDE:
            if tag == "br":
                held.append(" ")
            elif not closing and attributes and not attributes.endswith("/"):  # an inline element that is set aside becomes a container
                role, off = _signature(tag, attributes)
                if off and tag not in ("img", "input", "link", "meta", "a", "wbr", "area", "col", "embed", "source", "track", "base"):
                    flush()
                    tree.append((_below(tree[stack[-1]][0], role), stack[-1], True))
                    push(len(tree) - 1, tag)
            elif closing and names[-1] == tag and tree[stack[-1]][2]:
                flush()
                drop(1)
            continue
        flush()
        if closing:
            if opened[tag]:
                while names[-1] != tag:
                    drop(1)
                drop(1)
            elif tag in BLOCKS and (n := _ends("", names)):
                drop(n)
            continue
        if n := _ends(tag, names):
            drop(n)
        if tag in LISTS and not _signature(tag, attributes)[1]:  # open, so that its items end with it
            push(stack[-1], tag)
        elif not attributes.endswith("/") or tag not in ("hr",):
            role, off = _signature(tag, attributes)
            if tag in CONTAINERS or off:
                tree.append((_below(tree[stack[-1]][0], role), stack[-1], off or tree[stack[-1]][2]))
                push(len(tree) - 1, tag)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out, tree


def host_of(url: str | None) -> str:
    """Host of a page; pages whose url has none share the empty host."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _token(role: str, text: str) -> int:
    """A text block in its container, as one signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(f"{role}\0{text}".encode("utf-8", "replace")), "big", signed=True)


def occurrences(page: str) -> tuple[dict[str, tuple[int, int]], dict[tuple[str, int], int]]:
    """What is outside of what is set aside: per role of a container how often it occurs and the characters of text anywhere
    inside, and per (role, token of a text block in such a container) how often that occurs."""
    found, tree = blocks(page)
    chars = [0] * len(tree)
    texts: Counter[tuple[str, int]] = Counter()
    for c, text in found:
        texts[tree[c][0], _token(tree[c][0], text)] += 1
        while c >= 0:
            chars[c] += len(text)
            c = tree[c][1]
    out: dict[str, tuple[int, int]] = {}
    for (role, _, off), n in zip(tree, chars, strict=True):
        if not off:
            times, held = out.get(role, (0, 0))
            out[role] = (times + 1, held + n)
    return out, texts


def _counted(pages: DataFrame) -> DataFrame:
    """Per host, role and block (null: the container itself): a fingerprint of the occurrence vector over the host's pages,
    page and text counts, and a map of 64 bits in which each page content sets one.

    The fingerprint is a sum of hashes of (page, number of occurrences), so equal vectors have equal fingerprints, and it can be
    put together batch by batch: no host's pages ever meet in one place. Rows that repeat a page count as pages of their own.
    A block with the vector of its container has it in every batch too, so the others are left out of a batch's counts at once.
    """

    def count(b: pa.RecordBatch) -> dict:
        seen: dict[tuple[str, str, int | None], list[int]] = {}
        for url, data in zip(b.column("url").to_pylist(), b.column("data").to_pylist(), strict=True):
            host, page = host_of(url), xxhash.xxh3_64_intdigest(data + b"\0" + (url or "").encode())
            bit = 1 << (xxhash.xxh3_64_intdigest(data) & 63)
            containers, texts = occurrences(data.decode("utf-8", "replace"))
            rows = [(role, None, times, chars) for role, (times, chars) in containers.items()]
            rows += [(role, token, times, 0) for (role, token), times in texts.items()]
            for role, token, times, chars in rows:
                s = seen.setdefault((host, role, token), [0, 0, 0, 0, 0, 0])
                h = xxhash.xxh3_64_intdigest(page.to_bytes(8, "big") + times.to_bytes(4, "big"))
                for i, x in enumerate((h >> 32, h & 0xFFFFFFFF, 1, times, chars)):  # halves, so that sums stay whole numbers
                    s[i] += x
                s[5] |= bit
        keys = [k for k, s in seen.items() if k[2] is None or s[:4] == seen[(k[0], k[1], None)][:4]]
        names = ("high", "low", "pages", "times", "chars")
        sums = {n: pa.array([seen[k][i] for k in keys], pa.int64()) for i, n in enumerate(names)}
        bits = pa.array([seen[k][5] for k in keys], pa.uint64()).view(pa.int64())
        return {"host": [k[0] for k in keys], "role": [k[1] for k in keys], "block": pa.array([k[2] for k in keys], pa.int64()), **sums, "bits": bits}

    out = per_batch(pages, count, "host string, role string, block long, high long, low long, pages long, times long, chars long, bits long")
    sums = [F.sum(c).alias(c) for c in ("high", "low", "pages", "times", "chars")]
    out = out.groupBy("host", "role", "block").agg(*sums, F.bit_or("bits").alias("bits"))
    return out.withColumn("vector", F.xxhash64("high", "low")).drop("high", "low")


#: Share of the text that the article's slot holds at least, on average over the host: an article or main element, another container.
SHARE, WHOLE = 0.5, 0.9
#: Different page contents (as bits of a 64-bit map) and share of the host's pages that a class of the template stands behind.
PAGES, SUPPORT = 8, 0.05


def templates(pages: DataFrame) -> DataFrame:
    """``(host, slot, template, classes)``: the role whose slot holds the article, the blocks of the template, and how many
    equivalence classes the host has.

    Roles and blocks of a host with one occurrence vector form a class. The page itself (role '') spans the outermost class: what
    occurs exactly once on every page. A block is valid in a class, and nests in it, if it has the vector of its own container:
    it is there wherever that is, as often. Such blocks are the fixed text of the template, in the outermost class and in those of
    repeated or optional parts, if ``PAGES`` different pages and ``SUPPORT`` of the host's pages show it; so a host's template
    has at most 1 / ``SUPPORT`` times the blocks of a page. Copies of one page prove nothing.

    Inside the outermost class, an article or main element that holds at least ``SHARE`` of the text is the article's slot, else
    the innermost container that holds ``WHOLE`` of it: an article in sibling containers keeps them all. Classes that occur
    more often than once a page (rows of a list) are records inside a slot, never the slot.
    """
    counted = materialize(_counted(pages), "roles")
    roles = counted.where("block IS NULL")
    by_host = roles.groupBy("host").agg(F.count_distinct("vector").alias("classes"))
    whole = roles.where("role = ''").select("host", F.col("vector").alias("page_vector"), F.col("chars").alias("page_chars"), F.col("pages").alias("all_pages"))
    semantic = F.col("role").rlike(r"/(article|main)[^/]*$")
    depth = F.size(F.split("role", "/"))
    inside = roles.join(whole, "host").where(F.col("chars") >= F.when(semantic, SHARE).otherwise(WHOLE) * F.col("page_chars"))
    once = F.col("vector") == F.col("page_vector")
    # one aggregate per host: the best role in the outermost class, else the best of those on several pages
    order = F.struct(once, semantic, F.when(semantic, -depth).otherwise(depth), "chars", "role")
    best = inside.groupBy("host").agg(F.max_by("role", order).alias("slot"))
    shown = counted.where(F.col("block").isNotNull() & (F.bit_count("bits") >= PAGES))
    shown = shown.join(whole.select("host", "all_pages"), "host").where(f"pages >= {SUPPORT} * all_pages")
    nested = shown.join(roles.select("host", "role", "vector", "times"), ["host", "role", "vector", "times"], "left_semi")
    fixed = nested.groupBy("host").agg(F.sort_array(F.collect_set("block")).alias("template"))
    return by_host.select("host", "classes").join(best, "host", "left").join(fixed, "host", "left")


def main_text(page: str, slot: str | None, template: Collection[int] = ()) -> str:
    """The blocks inside the slot that are not the template's, one per line; all inside it if else nothing is left.
    A page without that slot: its article or main elements, else all blocks."""
    found, tree = blocks(page)
    inside = [bool(slot) and role == slot for role, _, _ in tree]
    if slot == "":
        inside[0] = True
    elif not any(inside):
        inside = [re.match(r"(article|main)(\.|$)", role.rpartition("/")[2]) is not None for role, _, _ in tree]
        if not any(inside):
            inside[0] = True
    for i, (_, parent, _) in enumerate(tree[1:], 1):
        inside[i] |= inside[parent]
    texts = [(tree[c][0], text) for c, text in found if inside[c]]
    own = [x for x in texts if _token(*x) not in template] if template else texts
    return "\n".join(text for _, text in own or texts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for every row: the article without what surrounds it.

    Two passes: the templates of all hosts from all pages, then what fills the slot of each page besides its host's template.
    Templates are one small row per host and join like any table (Spark broadcasts them only below its size limit).

    Null or empty html has no text; pages without a host share one template; repeated rows and repeated ids are pages of their
    own; very long pages are read whole. Character references are decoded, white space inside a block becomes one space.
    """
    base = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), present(html_col).alias("data")
    )
    found = materialize(templates(base.select("url", "data")).select(F.col("host").alias("h"), "slot", "template"), "templates")

    def name(b: pa.RecordBatch) -> dict:
        return {"id": b.column("id"), "url": b.column("url"), "data": b.column("data"), "h": pa.array([host_of(u) for u in b.column("url").to_pylist()], pa.string())}

    kind = base.schema["id"].dataType.simpleString()
    named = per_batch(base, name, f"id {kind}, url string, data binary, h string")

    def cut(b: pa.RecordBatch) -> dict:
        columns = (b.column(c).to_pylist() for c in ("data", "slot", "template"))
        texts = [main_text(d.decode("utf-8", "replace"), s, frozenset(t or ())) for d, s, t in zip(*columns, strict=True)]
        return {"id": b.column("id"), "url": b.column("url"), "text": pa.array(texts, pa.string()), "n": pa.array(map(len, texts), pa.int64())}

    out = per_batch(named.join(found, "h", "left").select("id", "url", "data", "slot", "template"), cut, f"id {kind}, url string, text string, n long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.col("n").alias("n_chars"))
