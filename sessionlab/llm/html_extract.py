"""HTML extraction by union-free wrapper inference: an expression for each host, whose slots hold the text.

A page is a tree of block elements. Neighbours of one form fold into a repeated group, and the trees of a host's pages are
aligned one after another: groups in both stay, a mismatch becomes an optional group or, where its label stands among its
neighbours already, a repeated stretch. All different trees of a host are aligned, in rounds of bounded parts, so no host meets in one
task. Each page is then matched against the expression of its host. A text that all different pages show at one place of
the expression is fixed and part of the wrapper; what differs, or stands on some pages only, fills a slot. The pages that
show each (host, place, text) are counted as rows of hashes, and only the fixed ones return to the pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sessionlab.llm.common import stage

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(script|style|noscript|template|iframe|svg|textarea|select|object)\b[^>]*>.*?(?:</\1\s*>|\Z)
|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S | re.I | re.X)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
DIGITS = re.compile(r"\d")
#: Elements within a block, elements without content, elements that a following one closes, elements never shown.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}
NEVER = frozenset("head title nav footer aside form button dialog menu input label fieldset".split())
#: Whole words of a class, id or role that mark what is no main text.
NOISE = frozenset("""ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus
    footer login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing
    sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget header""".split())
MAIN = frozenset(["article", "main"])
NEVER_MARKED = MAIN | {"html", "body"}
#: An expression holds so many groups beside one another and so many in all, this deep; what goes beyond folds into a
#: repeated group, then into one that holds anything (its texts then go by labels). Pages are cut nowhere.
SIDE, WHOLE, DEPTH = 64, 1024, 32
#: So many trees or expressions of a host are aligned in one group of a round, about.
FAN = 256


class Mark:
    """A marked element: its group, None where the element is hidden, and whether the mark holds."""

    __slots__ = ("group", "holds")

    def __init__(self, group: Group | None):
        self.group, self.holds = group, True


class Group:
    """An element: its label (tag and first class without digits, which often are a page's own), its groups, and whether it repeats, may be
    missing, shows text or holds anything. A group without label is a stretch: its groups in any order and number."""

    __slots__ = ("label", "groups", "many", "maybe", "text", "any", "place")

    def __init__(self, label: str, groups=(), many=False, maybe=False, text=False, any=False):
        self.label, self.groups, self.many, self.maybe, self.text, self.any, self.place = label, list(groups), many, maybe, text, any, 0

    def form(self) -> str:
        inside = "*" if self.any else ",".join(g.form() for g in self.groups)
        return f"{self.label}{'#' if self.text else ''}({inside}){'+' if self.many else ''}{'?' if self.maybe else ''}"

    def packed(self) -> list:
        return [self.label, self.many | self.maybe << 1 | self.text << 2 | self.any << 3, [g.packed() for g in self.groups]]

    @classmethod
    def unpacked(cls, row: list) -> Group:
        label, flags, groups = row
        return cls(label, map(cls.unpacked, groups), bool(flags & 1), bool(flags & 2), bool(flags & 4), bool(flags & 8))

    def size(self) -> int:
        return 1 + sum(g.size() for g in self.groups)


def folded(groups: list[Group]) -> list[Group]:
    """Neighbouring groups of one form become one repeated group."""
    out: list[Group] = []
    last = None
    for g in groups:
        form = g.form()
        if form == last:
            out[-1].many = True
        else:
            out.append(g)
            last = form
    return out


def stretch(groups: list[Group]) -> Group:
    """The repeated group that covers a stretch of groups: of one label itself, of several the least that holds each, in any order."""
    held: dict[str, Group] = {}
    for g in groups:
        for x in g.groups if not g.label else [g]:
            held[x.label] = merged(held[x.label], x) if x.label in held else x
    if len(held) == 1 and all(g.label for g in groups):
        (one,) = held.values()
        return Group(one.label, one.groups, True, all(g.maybe for g in groups), one.text, one.any)
    return Group("", [Group(g.label, g.groups, False, True, g.text, g.any) for g in held.values()], True, all(g.maybe for g in groups))


def labels(g: Group) -> set[str]:
    return {g.label} if g.label else {x.label for x in g.groups}


def covered(groups: list[Group], stretches: list[Group]) -> list[Group]:
    """Runs of groups that a stretch of the other side covers, as stretches."""
    for s in stretches:
        inside, out, run = labels(s), [], []
        for g in [*groups, None]:
            if g is not None and labels(g) <= inside:
                run.append(g)
                continue
            if run:
                whole = stretch(run)
                out.append(whole if not whole.label else Group("", [Group(whole.label, whole.groups, False, True, whole.text, whole.any)], True, whole.maybe))
            out += [g] if g is not None else []
            run = []
        groups = out
    return groups


def aligned(left: list[Group], right: list[Group]) -> list[Group]:
    """The groups that cover both lists. A group of only one list is optional, unless its label stands elsewhere in the
    result: then what lies from there to it repeats."""
    left, right = covered(left, [g for g in right if not g.label]), covered(right, [g for g in left if not g.label])
    out: list[tuple[Group, bool]] = []
    for kind, i, j, k, m in SequenceMatcher(None, [g.label for g in left], [g.label for g in right], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [(merged(x, y), False) for x, y in zip(left[i:j], right[k:m])]
        else:
            out += [(Group(g.label, g.groups, g.many, True, g.text, g.any), True) for g in [*left[i:j], *right[k:m]]]
    at = 0
    while at < len(out):
        g, alone = out[at]
        near = min((i for i, (x, _) in enumerate(out) if i != at and labels(x) & labels(g)), key=lambda i: (abs(i - at), i), default=None) if alone else None
        if near is None:
            at += 1
            continue
        lo, hi = min(at, near), max(at, near)
        # a stretch may meet the label of another group again, so it is looked at once more
        whole = stretch([x for x, _ in out[lo : hi + 1]])
        out[lo : hi + 1] = [(whole, not whole.label)]
        at = lo if not whole.label else lo + 1
    return [g for g, _ in out]


def merged(a: Group, b: Group) -> Group:
    """The least group that covers both."""
    many, maybe, text, any = a.many or b.many, a.maybe or b.maybe, a.text or b.text, a.any or b.any
    if any:
        return Group(a.label, [], many, maybe, text, True)
    if not a.label and (a.many or b.many):
        whole = stretch([a, b])
        return Group("", whole.groups, True, maybe)
    return Group(a.label, a.groups if a.form() == b.form() else limited(aligned(a.groups, b.groups)), many, maybe, text)


def limited(groups: list[Group]) -> list[Group]:
    return groups if len(groups) <= SIDE else [stretch(groups)]


def bounded(g: Group, depth: int = DEPTH) -> Group:
    """g with at most WHOLE groups: where it has more, its deepest hold anything."""
    def cut(g: Group, depth: int) -> Group:
        if g.any or (g.groups and (not depth or len(g.groups) > SIDE or any(not x.label and len(x.groups) > SIDE for x in g.groups))):
            return Group(g.label, [], g.many, g.maybe, g.text, True)
        return Group(g.label, [cut(x, depth - 1) for x in g.groups], g.many, g.maybe, g.text)

    g = cut(g, depth)
    while depth and g.size() > WHOLE:
        depth -= 1
        g = cut(g, depth)
    return g


def fold(g: Group, depth: int = DEPTH) -> Group:
    """A page's group as an expression of its own."""
    if not depth and g.groups:
        return Group(g.label, [], False, False, g.text, True)
    return Group(g.label, limited(folded([fold(x, depth - 1) for x in g.groups])), text=g.text)


def assigned(groups: list[Group], items: list[Group]) -> Iterator[tuple[str, Group | None]]:
    """For each group of a page the step to its item of the expression, and the item; None where the expression has none.

    Of the ways to match, the one that takes the earliest item but leaves a group for each item that must come.
    """
    inside = [labels(x) for x in items]
    kept: dict[int, int] = {}
    at = len(groups) - 1
    for i in (i for i in reversed(range(len(items))) if not items[i].maybe):
        while at >= 0 and groups[at].label not in inside[i]:
            at -= 1
        if at < 0:
            break
        kept[at] = i
        at -= 1
    at, used = 0, False
    for c, g in enumerate(groups):
        first = max(at + 1 if used and not items[at].many else at, kept.get(c, 0))
        found = next((i for i in range(first, len(items)) if g.label in inside[i]), None)
        if found is None:
            yield "=" + g.label, None
            continue
        at, used = found, True
        item = items[at]
        yield (str(at), item) if item.label else (f"{at}.{g.label}", next(x for x in item.groups if x.label == g.label))


def match(root: Group, expression: Group | None) -> None:
    """Gives each group of a page its place in the expression of its host. Where that has none, or holds anything, the
    place goes by labels; without an expression all do."""
    todo = [(root, expression)]
    while todo:
        g, item = todo.pop()
        if not g.groups:
            continue
        steps = assigned(g.groups, item.groups) if item is not None and not item.any else (("=" + x.label, None) for x in g.groups)
        for x, (step, below) in zip(g.groups, steps):
            x.place = hash_of(f"{g.place}/{step}")
            todo.append((x, below))


def blocks(page: str, texts: bool = True) -> tuple[list[tuple[tuple[str, ...], bool, tuple[Mark, ...], str, Group]], Group]:
    """(path, never text, marks, text, group) of each block of text in page order (none without texts), and the page as a group.

    The marks are those of the elements around a block. None holds around a main element, nor around the articles of a
    page that has no article outside marks (else those inside are comments, teasers and the like).
    """
    root = Group("")
    stack: list[tuple[str, Group, bool, tuple[Mark, ...]]] = [("", root, False, ())]
    out, parts = [], []
    articles: list[tuple[Mark, ...]] = []

    def end_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                stack[-1][1].text = True
            if text and texts:
                out.append((tuple(s[1].label for s in stack[1:]), stack[-1][2], stack[-1][3], text, stack[-1][1]))
            parts = []

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            parts.append(entities.unescape(page[at : token.start()]) if texts else page[at : token.start()])
        at = token.end()
        _, end, name, attributes, bare_end, bare, bare_attributes = token.groups()
        name = name or bare
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(end or bare_end), attributes or bare_attributes or ""
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        end_block()
        if closing:
            if stack[-1][0] == name or any(s[0] == name for s in stack[1:]):
                while stack.pop()[0] != name:
                    pass
            continue
        while len(stack) > 1 and name in CLOSED_BY.get(stack[-1][0], ()):
            stack.pop()
        given: dict[str, str] = {}
        for key, value in ATTRIBUTE.findall(attributes) if attributes else ():
            given.setdefault(key.lower(), value.strip("\"'").lower())
        first = next((c for c in given.get("class", "").split() if not DIGITS.search(c)), "")
        group = Group(f"{name}.{first}" if first else name)
        stack[-1][1].groups.append(group)
        if not texts:
            if name not in VOID:
                stack.append((name, group, False, ()))
            continue
        marks = stack[-1][3]
        if name == "main":
            for mark in marks:
                mark.holds = False
        elif name == "article":
            articles.append(marks)
        inside_main = any(s[0] in MAIN for s in stack)
        if given and name not in ("html", "body") and any(given.get(key, "false") != "false" for key in ("hidden", "aria-hidden")):
            marks += (Mark(None),)
        elif given and name not in NEVER_MARKED:
            words = {word for key in ("class", "id", "role") for word in given.get(key, "").split()} & NOISE
            if words - {"header"} or (words and not inside_main):
                marks += (Mark(group),)
        if name not in VOID:
            stack.append((name, group, stack[-1][2] or name in NEVER or (name == "header" and not inside_main), marks))
    if at < len(page):
        parts.append(entities.unescape(page[at:]) if texts else page[at:])
    end_block()
    if all(any(m.holds for m in marks) for marks in articles):
        for mark in (m for marks in articles for m in marks):
            mark.holds = False
    return out, root


def noise(block: tuple, confirmed: set[int] | None = None) -> bool:
    """Whether a block is no main text: by its elements or by a mark, if the host confirms it (None: as the words say)."""
    return block[1] or any(m.holds and (m.group is None or confirmed is None or place_hash(m.group, MARKED) in confirmed) for m in block[2])


class Wrapper:
    """The expression of pages."""

    def __init__(self, group: Group):
        self.group = group

    @classmethod
    def of(cls, page: str) -> "Wrapper":
        return cls(bounded(fold(blocks(page, texts=False)[1])))

    def add(self, other: "Wrapper") -> None:
        self.group = bounded(merged(self.group, other.group))

    def packed(self) -> str:
        return json.dumps(self.group.packed(), ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def unpacked(cls, text: str) -> "Wrapper":
        return cls(Group.unpacked(json.loads(text)))


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def place_hash(group: Group, text: str) -> int:
    return hash_of(f"{group.place}\n{text}")


def main_text(page: str, shared: set[int] | None = None, confirmed: set[int] | None = None, expression: Group | None = None) -> str:
    """The blocks of the main text of a page, joined by an empty line: what fills the slots of its host's expression, in its article
    and main elements; on a page without them all slots that are not noise, whatever their share of the text. Marks that
    leave nothing of a page do not count. shared and confirmed hold places that match gives by the expression."""
    found, root = blocks(page)
    match(root, expression)
    rest = [b for b in found if not noise(b, confirmed)] or [b for b in found if not b[1]]
    chosen = [b for b in rest if not (shared and place_hash(b[4], b[3]) in shared)]
    return "\n\n".join(b[3] for b in [b for b in chosen if any(part.split(".")[0] in MAIN for part in b[0])] or chosen)


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


#: The place that stands for a whole page: its count is that of the host's different pages.
PAGE = 0
#: What stands for the text of a marked element. The host confirms a mark that at least two of its pages, and one in so
#: many, show at the same place.
MARKED, ONE_IN = "\0", 10


def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, expression): the different expressions of single pages."""
    for batch in batches:
        rows = dict.fromkeys((host, Wrapper.of(html).packed()) for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()))
        columns = list(zip(*rows)) if rows else [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string()))], ["host", "expression"])


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, part, expression) sorted by host and part to one row for each of these: the expression that covers all."""
    key, held, done = None, None, []

    def rows() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([h for h, _ in done], pa.int64()), pa.array([e for _, e in done], pa.string())], ["host", "expression"])
        done.clear()
        return batch

    for batch in batches:
        for host, part, packed in zip(batch["host"].to_pylist(), batch["part"].to_pylist(), batch["expression"].to_pylist()):
            if (host, part) == key:
                held.add(Wrapper.unpacked(packed))
                continue
            if held is not None:
                done.append((key[0], held.packed()))
            key, held = (host, part), Wrapper.unpacked(packed)
        yield rows()
    if held is not None:
        done.append((key[0], held.packed()))
        yield rows()


def expressions(pages: DataFrame) -> DataFrame:
    """(host, expression): the union-free expression of each host, inferred from all its different pages' trees.

    pages: (host, html). The trees of a host are dealt to parts of about FAN by their hashes, aligned in their order within
    each part, and what results is dealt again until one is left; so the expression does not depend on how rows lie.
    """
    found = stage(pages.mapInArrow(forms, "host long, expression string").distinct(), "forms")
    while True:
        sizes = stage(found.groupBy("host").agg(F.count("*").alias("n")), "sizes")
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return found
        part = F.when(F.col("n") <= FAN, 0).otherwise(F.pmod(F.xxhash64("expression"), F.ceil(F.col("n") / FAN)))
        dealt = found.join(sizes, "host").select("host", part.cast("long").alias("part"), "expression")
        found = stage(dealt.repartition("host", "part").sortWithinPartitions("host", "part", "expression").mapInArrow(align, "host long, expression string").distinct(), "forms")


def unpacked(column: pa.Array | None, row: int) -> Group | None:
    return None if column is None or not column[row].is_valid else Wrapper.unpacked(column[row].as_py()).group


def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, expression) to (host, marked, place, page): each text at its place in the host's expression, each mark at
    its own, and PAGE, with the page that shows it.

    Pages are told apart by their text outside noise, so one that only differs in its adverts counts once.
    """
    for batch in batches:
        rows: dict[tuple[int, bool, int, int], None] = {}
        known: dict[int, Group | None] = {}
        given = batch["expression"] if "expression" in batch.schema.names else None
        for i, (host, html) in enumerate(zip(batch["host"].to_pylist(), batch["html"].to_pylist())):
            if host not in known:
                known[host] = unpacked(given, i)
            every, root = blocks(html)
            match(root, known[host])
            found = [b for b in every if not noise(b)]
            page = hash_of("\n".join(b[3] for b in found))
            rows[host, False, PAGE, page] = None
            for _, _, _, text, group in found:
                rows[host, False, place_hash(group, text), page] = None
            for place in {place_hash(m.group, MARKED) for b in every for m in b[2] if m.holds and m.group}:
                rows[host, True, place, page] = None
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], ["host", "marked", "place", "page"])


def rules(pages: DataFrame) -> DataFrame:
    """(host, shared, confirmed) of the hosts with at least three different pages: the fixed texts, as hashes of place and
    text, that all of these show, and the places of confirmed marks.

    pages: (host, html), and the expression of the host; without it places go by labels. Each (host, place) is counted by
    itself in partial sums; no host meets in one task. No list grows with its host: all pages show each shared text, and
    one in ten each confirmed mark.
    """
    rows = pages.mapInArrow(shown, "host long, marked boolean, place long, page long").distinct()
    counts = stage(rows.groupBy("host", "marked", "place").agg(F.count("*").alias("n")).where("n >= 3 or marked and n >= 2"), "counts")
    hosts = counts.where((F.col("place") == PAGE) & ~F.col("marked")).select("host", "n")
    shared = counts.where((F.col("place") != PAGE) & ~F.col("marked")).join(hosts, ["host", "n"]).groupBy("host").agg(F.collect_list("place").alias("shared"))
    marks = counts.where("marked").withColumnRenamed("n", "seen").join(hosts, "host").where(F.col("seen") * ONE_IN >= F.col("n"))
    confirmed = marks.groupBy("host").agg(F.collect_list("place").alias("confirmed"))
    none = F.array().cast("array<long>")
    return hosts.select("host").join(shared, "host", "left").join(confirmed, "host", "left").select("host", F.coalesce("shared", none).alias("shared"), F.coalesce("confirmed", none).alias("confirmed"))


#: Lists and expressions of up to this many bytes together are sent to all executors; beyond, pages meet theirs in a shuffle.
BROADCAST_BYTES = 16 << 20


def bytes_of(found: DataFrame) -> int:
    """Bytes of the rows of rules: 8 a hash and about 40 for the rest of a row."""
    return found.agg(F.sum(8 * (F.size("shared") + F.size("confirmed")) + 40)).first()[0] or 0


def small(found: DataFrame, bytes: int) -> DataFrame:
    return F.broadcast(found) if bytes <= BROADCAST_BYTES else found


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text (empty if none), n_chars.

    A null html is empty; pages without a host in their url form one host. Repeated pages count once towards fixed text;
    a text is only taken for part of the wrapper if all of at least three different pages show it at the same place of the
    host's expression, and such a host must show a marked place on several pages for the mark to hold.
    Other columns are ignored, an empty table gives an empty result.
    """
    work = pages.select("page_id", "url", F.xxhash64(host_of("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    inferred = expressions(work.select("host", "html"))
    length = inferred.agg(F.sum(F.octet_length("expression") + 40)).first()[0] or 0
    lists = stage(rules(work.select("host", "html").join(small(inferred, length), "host", "left")), "wrappers")
    work = work.join(small(inferred.join(lists, "host", "left"), length + bytes_of(lists)), "host", "left").select("page_id", "url", "html", "host", "shared", "confirmed", "expression")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, tuple] = {}
            texts = []
            for i, (host, page) in enumerate(zip(batch["host"].to_pylist(), batch["html"].to_pylist())):
                if host not in known:
                    known[host] = (*(set(x.as_py()) if x.is_valid else None for x in (batch["shared"][i], batch["confirmed"][i])), unpacked(batch["expression"], i))
                texts.append(main_text(page, *known[host]))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    ids = pages.schema["page_id"].dataType.simpleString()
    return work.mapInArrow(run, f"page_id {ids}, url string, text string, n_chars long")
