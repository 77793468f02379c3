"""Pages to nodes (an Euler tour of each page), and the features of nodes that programs select by."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
#: What an opening tag closes: elements of these kinds, up to (not through) the nearest of the second kinds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}

#: Elements that a task holds before it gives them on; a larger page stands alone.
HELD = 2_000

#: What parse_nodes gives.
SCHEMA = "page_id long, url string, node_id int, parent_id int, doc_order int, depth int, sib_index int, tag string, id string, class string, style string, xpath string, own_text string, text string, link string"

#: Elements as an Euler tour: an element's descendants are those up to `last`, its text is [start, end) of the page's text, its path the pieces of the
#: page's paths that `chain`, `at`, `up` and `jumps` lead to. All other relations are numbers of elements, so a page takes space in proportion to its length.
_INTS = ["parent", "last", "depth", "sib", "nth", "alike", "start", "end", "link_at", "prev", "first", "final", "before", "heading", "chain", "at", "up", "jumps"]
_TEXTS = ["tag", "id", "class", "style", "own", "href"]
LAYOUT = f"page_id long, url string, page_text binary, page_paths binary, nodes array<struct<n:int,{','.join(f'{c}:int' for c in _INTS)},{','.join(f'{c}:string' for c in _TEXTS)}>>"


class _Parser(HTMLParser):
    """Elements in document order, with the page's visible text once: white space as one space, a newline around block elements and at <br>."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.open_tags: Counter[str] = Counter()
        self.top: dict = {"children": 0, "counts": {}}
        self.text: list[bytes] = []
        self.size = 0
        self.gap = b""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close({"p"}, {"button", "td", "th", "li", "div", "article", "section", "body", "table"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS or tag == "br":
            self.gap = b"\n"
        parent = self.open[-1] if self.open else None
        above = self.nodes[parent] if parent is not None else self.top
        above["children"] += 1
        nth = above["counts"][tag] = above["counts"].get(tag, 0) + 1
        n = len(self.nodes)
        node = {"tag": tag, "parent": parent, "attrs": {k: v or "" for k, v in reversed(attrs)}, "children": 0, "counts": {}, "own": [], "sib": above["children"], "nth": nth, "start": self.size, "end": self.size, "last": n, "prev": above.get("final"), "first": None}
        above.setdefault("first", None)
        above["first"], above["final"] = n if above["first"] is None else above["first"], n
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(n)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._shut(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                self._shut(k)
                return

    def handle_data(self, data: str) -> None:
        if not self.open:
            return
        node = self.nodes[self.open[-1]]
        if node["tag"] in ("script", "style"):
            return
        node["own"].append(data)
        words = data.split()
        if not words or data[0].isspace():
            self.gap = self.gap or (b" " if data else b"")
        if words:
            piece = (self.gap if self.size else b"") + " ".join(words).encode("utf-8", "replace")
            self.text.append(piece)
            self.size += len(piece)
            self.gap = b" " if data[-1].isspace() else b""

    def close(self) -> None:
        super().close()
        self._shut(0)

    def _shut(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for n in reversed(self.open[k:]):
            node = self.nodes[n]
            node["end"], node["last"] = self.size, len(self.nodes) - 1
            self.open_tags[node["tag"]] -= 1
            if node["tag"] in BLOCKS:
                self.gap = b"\n"
        del self.open[k:]

    def _close(self, kinds: set[str], stop: set[str]) -> None:
        if not any(self.open_tags[k] for k in kinds):
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.nodes[self.open[k]]["tag"]
            if tag in kinds:
                self._shut(k)
                return
            if tag in stop:
                return


def _absolute(url: str | None, href: str) -> str:
    try:
        return urljoin(url or "", href.strip())
    except ValueError:
        return href


def _paths(nodes: list[dict]) -> bytes:
    """Every element's step once, chain by chain, and in each element where its path is.

    A chain goes on with the child of most descendants, so its steps stand side by side; a path is a prefix of the element's chain after the path of
    the element above that chain, and leaves a chain at most log2(n) times.
    """
    out, size = [], 0
    for head, node in enumerate(nodes):
        p = node["parent"]
        if p is not None and nodes[p].get("main") == head:
            continue
        chain, n = size, head
        while True:
            it = nodes[n]
            step = f"/{it['tag']}[{it['nth']}]".encode("utf-8", "replace")
            out.append(step)
            size += len(step)
            it |= {"chain": chain, "at": size, "up": p, "jumps": 1 if p is None else nodes[p]["jumps"] + 1}
            child = it["first"]
            best = None
            while child is not None:
                if best is None or nodes[child]["last"] - child > nodes[best]["last"] - best:
                    best = child
                child = nodes[child].get("next")
            if best is None:
                break
            it["main"] = n = best
    return b"".join(out)


def page_layout_of(url: str | None, html: str | None) -> tuple[bytes, bytes, list[dict]]:
    """(text, paths, elements) of a page. Broken and empty pages give what can be read."""
    parser = _Parser()
    parser.feed(html or "")
    parser.close()
    nodes, before, heading = parser.nodes, None, None
    for n, node in enumerate(nodes):
        p = node["parent"]
        above = nodes[p] if p is not None else parser.top
        if node["prev"] is not None:
            nodes[node["prev"]]["next"] = n
        a, linked = node["attrs"], node["tag"] == "a" and "href" in node["attrs"]
        node |= {
            "n": n, "alike": above["counts"][node["tag"]], "depth": 0 if p is None else above["depth"] + 1, "own": " ".join("".join(node["own"]).split()), "id": a.get("id"), "class": a.get("class"), "style": a.get("style"),
            "href": _absolute(url, a["href"]) if linked else None, "link_at": n if linked else None if p is None else above["link_at"], "before": before, "heading": heading,
        }
        node.setdefault("final", None)
        before = n if node["own"] else before
        heading = n if node["tag"] in ("h1", "h2", "h3", "h4", "h5", "h6") else heading
    return b"".join(parser.text), _paths(nodes), nodes


def page_layout(pages: DataFrame) -> DataFrame:
    """One row a page (`LAYOUT`): its text and paths once, its elements with their places in them. No shuffle; each page is parsed alone.

    Unclosed p, li, td and the like are closed; null and empty pages have no elements. Nothing here repeats what stands inside an element, so a deeply
    nested page takes no more space than a flat one. `select_nodes` makes rows of elements.
    """
    names = [c.split()[0] for c in LAYOUT.split(", ")]
    fields = ["n", *_INTS, *_TEXTS]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        every = [n for *_, nodes in held for n in nodes]
        columns = [pa.array([n[f] for n in every], pa.int32() if k <= len(_INTS) else pa.string()) for k, f in enumerate(fields)]
        offsets = [0]
        for *_, nodes in held:
            offsets.append(offsets[-1] + len(nodes))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields))
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([*(pa.array([h[k] for h in held], kind) for k, kind in enumerate(kinds)), lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):  # page by page: a batch may hold very many
                page_id, url, html = (c[k].as_py() for c in batch.columns)
                held.append((page_id, url, *page_layout_of(url, html)))
                size += len(held[-1][-1])
                if size > HELD:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, LAYOUT)


def element(n: Column) -> Column:
    """The element of this number on the row's page; null for none."""
    return F.get(F.col("nodes"), n)


def text_of(node: Column) -> Column:
    """An element's visible text, cut out of the page's text."""
    return F.btrim(F.substring(F.col("page_text"), node["start"] + 1, node["end"] - node["start"]).cast("string"), F.lit(" \n"))


def link_of(node: Column) -> Column:
    """The href of the element or of the link around it, made absolute; null where there is none."""
    return element(node["link_at"])["href"]


def xpath_of(node: Column) -> Column:
    """An element's path, put together from the pieces of the page's paths."""
    begin = F.struct(F.lit("").alias("path"), node["n"].alias("n"))

    def step(so_far: Column, _: Column) -> Column:
        at = element(so_far["n"])
        return F.struct(F.concat(F.substring(F.col("page_paths"), at["chain"] + 1, at["at"] - at["chain"]).cast("string"), so_far["path"]).alias("path"), at["up"].alias("n"))

    return F.when(node.isNotNull(), F.aggregate(F.sequence(F.lit(1), node["jumps"]), begin, step)["path"])


#: Columns of elements by name; those after `link` are the features N6-N9.
COLUMNS: dict[str, Callable[[Column], Column]] = {
    "node_id": lambda n: n["n"], "parent_id": lambda n: n["parent"], "doc_order": lambda n: n["n"], "depth": lambda n: n["depth"], "sib_index": lambda n: n["sib"], "tag": lambda n: n["tag"],
    "id": lambda n: n["id"], "class": lambda n: n["class"], "style": lambda n: n["style"], "xpath": xpath_of, "own_text": lambda n: n["own"], "text": text_of, "link": link_of,
    "precedingText": lambda n: element(n["before"])["own"], "possibleHeading": lambda n: text_of(element(n["heading"])), "previousElementSiblingText": lambda n: text_of(element(n["prev"])),
    "childTag": lambda n: element(n["first"])["tag"], "childText": lambda n: text_of(element(n["first"])), "lastChildTag": lambda n: element(n["final"])["tag"], "lastChildText": lambda n: text_of(element(n["final"])),
}
NODE_COLUMNS = list(COLUMNS)[:13]


def select_nodes(layout: DataFrame, where: Callable[[Column], Column] | None = None, columns: Sequence[str] = NODE_COLUMNS) -> DataFrame:
    """Elements as rows: page_id, url and `columns` (of `COLUMNS`). No shuffle.

    `where` gets an element (fields as in `LAYOUT`) and tells whether it is wanted: texts and paths are made for those only.
    """
    found = F.col("nodes") if where is None else F.filter("nodes", where)
    rows = F.transform(found, lambda n: F.struct(*[COLUMNS[c](n).alias(c) for c in columns]))
    return layout.select("page_id", "url", F.explode(rows).alias("_rl_n")).select("page_id", "url", "_rl_n.*")


def parse_nodes(pages: DataFrame, where: Callable[[Column], Column] | None = None, columns: Sequence[str] = NODE_COLUMNS) -> DataFrame:
    """The elements of stored pages as rows (`SCHEMA`), or those `where` tells, with some columns.

    `text` has a newline between block elements; `link` is the href of the element or of the link
    around it, made absolute, null where there is none. Unclosed p, li, td and the like are closed. All texts and paths of
    a deeply nested page take far more space than the page; name the elements or columns that are wanted.
    """
    return select_nodes(page_layout(pages), where, columns)


def steps_of(xpath: str) -> list[tuple[str, int | None]]:
    """The steps of a path as (tag, number); the number of a [*] step is None."""
    found = [re.fullmatch(r"([^\[\]]+)\[(\d+|\*)\]", s) for s in xpath.strip("/").split("/")] if xpath.strip("/") else []
    if not all(found):
        raise ValueError(f"no plain path: {xpath}")
    return [(m[1], None if m[2] == "*" else int(m[2])) for m in found]


def is_step(node: Column, step: tuple[str, int | None]) -> Column:
    return node["tag"] == step[0] if step[1] is None else (node["tag"] == step[0]) & (node["nth"] == step[1])


def at_xpath(xpath: str) -> Callable[[Column], Column]:
    """For `where`: the element at this path. Paths are made for elements of the same depth and last step only."""
    steps = steps_of(xpath)
    return lambda n: F.when((n["depth"] == len(steps) - 1) & is_step(n, steps[-1]), xpath_of(n) == xpath).otherwise(False)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def child_at(node: Column, steps: Sequence[tuple[str, int]]) -> Column:
    """The element below `node` at these steps; null for none. Only the element's own part of the page is searched, once for each step."""

    def below(above: Column, step: tuple[str, int]) -> Column:
        inside = F.slice(F.col("nodes"), above["n"] + 2, above["last"] - above["n"])
        return F.get(F.filter(inside, lambda x: (x["parent"] == above["n"]) & is_step(x, step)), F.lit(0))

    return reduce(lambda above, step: once(above, lambda x: below(x, step)), steps, node)


def page_nodes(page_id: int | None, url: str | None, html: str | None) -> list[tuple]:
    """The rows of parse_nodes for one page, without Spark: to look at a page."""
    text, paths, nodes = page_layout_of(url, html)
    rows = []
    for n in nodes:
        path, at = b"", n["n"]
        while at is not None:
            path, at = paths[nodes[at]["chain"] : nodes[at]["at"]] + path, nodes[at]["up"]
        link = None if n["link_at"] is None else nodes[n["link_at"]]["href"]
        rows.append((page_id, url, n["n"], n["parent"], n["n"], n["depth"], n["sib"], n["tag"], n["id"], n["class"], n["style"], path.decode(), n["own"], text[n["start"] : n["end"]].decode().strip(" \n"), link))
    return rows


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    """The first n words, fewer if there are no more."""
    return F.array_join(F.slice(words_of(text), 1, n), " ")


def last_word(text: Column) -> Column:
    """Empty for a text without words."""
    return F.coalesce(F.try_element_at(words_of(text), F.lit(-1)), F.lit(""))


def pre_colon_text(text: Column) -> Column:
    """What stands before the first colon; null without one."""
    return F.when(F.instr(text, ":") > 0, F.substring_index(text, ":", 1))


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.col(text)
    return df.withColumns({"firstWord": first_words(t, 1), "firstTwoWords": first_words(t, 2), "firstThreeWords": first_words(t, 3), "lastWord": last_word(t), "preColonText": pre_colon_text(t)})


def context_features(nodes: DataFrame) -> DataFrame:
    """Text of the previous sibling, nearest earlier own text, nearest earlier heading. One sort by page serves the last two."""
    siblings = Window.partitionBy("page_id", "parent_id").orderBy("sib_index", "doc_order")
    earlier = Window.partitionBy("page_id").orderBy("doc_order").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("own_text") != "", F.col("own_text"))
    heading = F.when(F.col("tag").rlike("^h[1-6]$"), F.col("text"))
    return nodes.withColumns({"precedingText": F.last(own, ignorenulls=True).over(earlier), "possibleHeading": F.last(heading, ignorenulls=True).over(earlier), "previousElementSiblingText": F.lag("text").over(siblings)})


def child_features(nodes: DataFrame) -> DataFrame:
    """Tag and text of the first and last child; null without children."""
    at = F.struct("sib_index", "doc_order")
    ends = nodes.where("parent_id is not null").groupBy("page_id", "parent_id").agg(
        F.min_by("tag", at).alias("childTag"), F.min_by("text", at).alias("childText"), F.max_by("tag", at).alias("lastChildTag"), F.max_by("text", at).alias("lastChildText")
    )
    return nodes.join(ends.withColumnRenamed("parent_id", "node_id"), ["page_id", "node_id"], "left")


def style_value(style: Column, name: str) -> Column:
    """A value of an inline style; null where it is not set."""
    found = F.regexp_extract(style, rf"(?i)(?:^|;)\s*{name}\s*:\s*([^;]*)", 1)
    return F.when(F.trim(found) != "", F.trim(found))
