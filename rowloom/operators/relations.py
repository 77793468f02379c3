"""Tables on pages: finding them, generalising a first row, extracting and editing rows."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import nodes as pages
from .base import blank, first_by


@dataclass(frozen=True)
class RelationSpec:
    """A table on a page. `row_selector` is an xpath with one [*] step; a column is a path below it ("" for the row itself)."""

    name: str
    row_selector: str
    columns: Mapping[str, str] = field(default_factory=dict)
    exclude_first: int = 0


def find_relations(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Groups of sibling elements of one kind: page_id, parent_xpath, tag, n_rows. `nodes` is a layout of pages (no shuffle) or rows of elements."""
    if "nodes" in nodes.columns:
        found = F.filter("nodes", lambda n: n["parent"].isNotNull() & (n["nth"] == 1) & (n["alike"] >= least))
        groups = F.transform(found, lambda n: F.struct(pages.xpath_of(pages.element(n["parent"])).alias("parent_xpath"), n["tag"].alias("tag"), n["alike"].cast("long").alias("n_rows")))
        return nodes.select("page_id", F.inline(groups))
    parent = F.regexp_replace("xpath", r"/[^/]*$", "")
    return nodes.where("parent_id is not null").groupBy("page_id", parent.alias("parent_xpath"), "tag").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


_RECORDS = {
    "parent_xpath": ("string", pa.string()), "table_no": ("int", pa.int32()), "row_idx": ("long", pa.int64()), "row_xpath": ("string", pa.string()),
    "text": ("map<string,string>", pa.map_(pa.string(), pa.string())), "link": ("map<string,string>", pa.map_(pa.string(), pa.string())), "n_missing": ("int", pa.int32()),
}


def _features(kinds: list[str], children: list[list[int]], n: int) -> tuple:
    """The shape of an element: the multiset of its children's kinds, with that of their children."""
    found = Counter()
    for c in children[n]:
        kind = kinds[c]
        found[kind] += 1
        for d in children[c]:
            found[f"{kind}/{kinds[d]}"] += 1
    return tuple(sorted(found.items()))


def _kind(node: dict) -> str:
    if not node["class"]:
        return node["tag"]
    names = node["class"].split()
    return ".".join([node["tag"], *sorted(names)])


def _overlap(a: Mapping[str, int], b: Mapping[str, int]) -> tuple[float, float]:
    """The share of the smaller multiset that the other has too, and the shared part of both; 1 for two empty ones."""
    small, every = sorted((sum(a.values()), sum(b.values())))
    both = sum(min(k, b.get(x, 0)) for x, k in a.items())
    return (both / small, both / (small + every - both)) if small else (float(not every),) * 2


def _tables(nodes: list[dict], least: int, overlap: float) -> list[dict]:
    """The tables of a page: siblings of like shape as rows, their parts with text or a link as cells."""
    children: list[list[int]] = [[] for _ in nodes]
    for k, n in enumerate(nodes):
        if n["parent"] is not None:
            children[n["parent"]].append(k)
    found, kinds = [], [_kind(n) for n in nodes]
    for parent, below in enumerate(children):
        if len(below) < least:
            continue
        shapes: dict[tuple, list[int]] = {}
        for c in below:
            shapes.setdefault((nodes[c]["tag"], _features(kinds, children, c)), []).append(c)
        groups: list[tuple[str, Counter, list[int]]] = []
        for (tag, shape), rows in sorted(shapes.items(), key=lambda x: (-len(x[1]), x[1][0])):
            shape = Counter(dict(shape))
            alike = [(x[1], -k) for k, g in enumerate(groups) if g[0] == tag and (x := _overlap(g[1], shape))[0] >= overlap]
            group = groups[-max(alike)[1]] if alike else None
            if group is None:
                groups.append((tag, shape, [*rows]))
            else:
                group[1].update(shape - group[1])
                group[2].extend(rows)
        for _, _, rows in groups:
            if len(rows) >= least:
                cells = [_row_cells(nodes, kinds, children, r) for r in sorted(rows)]
                order = dict.fromkeys(name for row in cells for name in row)
                found.append({"parent": parent, "rows": list(zip(sorted(rows), cells, strict=True)), "names": list(order)})
    return found


def _row_cells(nodes: list[dict], kinds: list[str], children: list[list[int]], row: int) -> dict[str, int]:
    """The parts of a row by name: kinds of elements from the row down, numbered where a kind comes again; the row itself is \"\"."""
    out: dict[str, int] = {}
    stack = [(row, "")]
    while stack:
        n, name = stack.pop()
        if nodes[n]["own"] or nodes[n]["href"] is not None:
            out[name] = n
        seen: Counter[str] = Counter()
        below = []
        for c in children[n]:
            kind = kinds[c]
            seen[kind] += 1
            step = kind if seen[kind] == 1 else f"{kind}[{seen[kind]}]"
            below.append((c, f"{name}/{step}" if name else step))
        stack.extend(reversed(below))
    return out


def _record_rows(page_id: object, paths: bytes, nodes: list[dict], least: int, overlap: float) -> Iterator[tuple]:
    """The rows of `find_records` for one page."""

    def xpath(n: int | None) -> str:
        path = b""
        while n is not None:
            path, n = paths[nodes[n]["chain"] : nodes[n]["at"]] + path, nodes[n]["up"]
        return path.decode()

    def link(n: int | None) -> str:
        at = None if n is None else nodes[n]["link_at"]
        return "" if at is None else nodes[at]["href"] or ""

    for no, table in enumerate(_tables(nodes, least, overlap), 1):
        above = xpath(table["parent"])
        for i, (n, cells) in enumerate(table["rows"], 1):
            found = [(c, cells.get(c)) for c in table["names"]]
            text = [(c, "" if x is None else nodes[x]["own"] or "") for c, x in found]
            yield page_id, above, no, i, xpath(n), text, [(c, link(x)) for c, x in found], len(found) - len(cells)


def find_records(layout: DataFrame, least: int = 2, overlap: float = 0.5) -> DataFrame:
    """R1 R2 by structure: tables whose rows may lack parts, have extra ones, or stand among siblings of another kind.

    Each element has a shape, the multiset of the kinds (tag and classes) of its children and their children. Siblings of one tag are
    put together if the smaller shape is at least `overlap` within the other, with the group most like it (shapes taken by frequency, a table's shape grows by what its rows add); groups of `least`
    rows or more are tables. A row's cells are its elements with text or a link of their own, by the kinds of elements on the way down, so a part that is missing
    does not move the others. Gives a row for each row of a table: page_id, parent_xpath, table_no (on the page), row_idx from 1, row_xpath,
    text and link (maps from the table's column names to cells; missing cells are empty), n_missing. `layout` is a layout of pages, or stored pages, which are then
    parsed in the same step. Pages are independent: no shuffle.
    """
    stored = "html" in layout.columns
    fields = ["parent", "tag", "class", "own", "href", "link_at", "chain", "at", "up"]

    def of_pages(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k in range(batch.num_rows):
            page_id, url, html = (c[k].as_py() for c in batch.columns)
            _, paths, nodes = pages.page_layout_of(url, html)
            yield page_id, paths, nodes

    def of_layout(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k in range(batch.num_rows):
            nodes = batch.column(2).slice(k, 1).flatten()
            yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), [dict(zip(fields, values, strict=True)) for values in zip(*(nodes.field(f).to_pylist() for f in fields), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            ids = batch.schema.field(0).type
            for page in of_pages(batch) if stored else of_layout(batch):
                held.extend(_record_rows(*page, least, overlap))
                if len(held) > pages.HELD:
                    yield batch_of(held, ids)
                    held = []
            if held:
                yield batch_of(held, ids)

    def batch_of(held: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        kinds = [ids, *(kind for _, kind in _RECORDS.values())]
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(zip(*held, strict=True), kinds, strict=True)], names=["page_id", *_RECORDS])

    rows = layout.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")) if stored else layout.select("page_id", "page_paths", "nodes")
    return rows.mapInArrow(run, ", ".join([f"page_id {rows.schema['page_id'].dataType.simpleString()}", *(f"{c} {kind}" for c, (kind, _) in _RECORDS.items())]))


def row_selectors(cells: Sequence[str]) -> list[RelationSpec]:
    """The ways to make one step of the cells' common xpath general, outermost first."""
    steps = [c.strip("/").split("/") for c in cells]
    common = next((k for k in range(min(map(len, steps))) if len({s[k] for s in steps}) > 1), min(map(len, steps)))
    out = []
    for k in range(common):
        head, tail = steps[0][:k], [s[k + 1 :] for s in steps]
        row = "/" + "/".join([*head, re.sub(r"\[\d+\]$", "[*]", steps[0][k])])
        if row.endswith("[*]"):
            out.append(RelationSpec(f"depth_{k}", row, {f"c{i}": "".join(f"/{x}" for x in t) for i, t in enumerate(tail)}))
    return out


def infer_row_selector(nodes: DataFrame, cells: Sequence[str]) -> DataFrame:
    """R2: candidates from a demonstrated first row (cell xpaths): selector, seq and n_rows, the rows that have every cell.

    All candidates are counted in one pass over the nodes: each node is a cell of the candidates that select it.
    """
    specs = row_selectors(cells)
    if specs and "nodes" in nodes.columns:
        counted = nodes.select(*_with_base(specs)[1]).select(*[F.size(F.filter(_rows_at(s, F.col(f"_rl_base{k}")), _whole)).alias(f"n{k}") for k, s in enumerate(specs)])
        total = counted.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(specs))])
        each = F.array(*[F.struct(F.lit(s.row_selector).alias("selector"), F.lit(k).alias("seq"), F.coalesce(F.col(f"n{k}"), F.lit(0)).cast("long").alias("n_rows")) for k, s in enumerate(specs)])
        return total.select(F.inline(each))
    if not specs:
        return nodes.sparkSession.createDataFrame([], "selector string, seq int, n_rows long")
    none = F.lit(None).cast("struct<seq:int,row_no:int,cell:string>")
    hits = F.array(*[F.when((row := _row_no(s)).isNotNull(), F.struct(F.lit(k).alias("seq"), row.alias("row_no"), _below(s).alias("cell"))).otherwise(none) for k, s in enumerate(specs)])
    paths = F.create_map(*[x for k, s in enumerate(specs) for x in (F.lit(k), F.array(*[F.lit(p) for p in s.columns.values()]))])
    found = nodes.select("page_id", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select("page_id", "h.*").where(F.array_contains(paths[F.col("seq")], F.col("cell")))
    rows = found.groupBy("seq", "page_id", "row_no").agg(F.count_distinct("cell").alias("n"))
    need = F.create_map(*[F.lit(x) for k, s in enumerate(specs) for x in (k, len(set(s.columns.values())))])
    counts = rows.where(F.col("n") == need[F.col("seq")]).groupBy("seq").agg(F.count("*").alias("n_rows"))
    every = nodes.sparkSession.createDataFrame([(s.row_selector, k) for k, s in enumerate(specs)], "selector string, seq int")
    return every.join(F.broadcast(counts), "seq", "left").select("selector", "seq", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def _row_no(spec: RelationSpec) -> Column:
    """The number of the row that a node is in; null outside the table."""
    head, _, tail = spec.row_selector.partition("[*]")
    row = F.regexp_extract("xpath", "^" + re.escape(head) + r"\[(\d+)\]" + re.escape(tail) + r"(?=/|$)", 1)
    return F.when(F.startswith("xpath", F.lit(head + "[")), row).try_cast("int")


def _below(spec: RelationSpec) -> Column:
    """A node's path below its row."""
    head, _, tail = spec.row_selector.partition("[*]")
    return F.regexp_replace("xpath", "^" + re.escape(head) + r"\[\d+\]" + re.escape(tail), "")


def best_candidate(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The longest candidate that is not empty; a later one wins over an earlier one of equal length."""
    some = candidates.where("n_rows > 0")
    best = some.groupBy(*by).agg(F.max_by(F.struct(*[c for c in some.columns if c not in by]), F.struct("n_rows", "seq")).alias("best"))
    return best.where("best is not null").select(*by, "best.*")


def _with_base(specs: Sequence[RelationSpec]) -> tuple[list[str], list[str | Column]]:
    """A layout's columns, with the element above the rows of each table."""
    names = [f"_rl_base{k}" for k in range(len(specs))]
    base = []
    for s in specs:
        head = s.row_selector.partition("[*]")[0].rpartition("/")[0]
        base.append(F.get(F.filter("nodes", pages.at_xpath(head)), F.lit(0)) if head else F.lit(None))
    return names, ["page_id", "page_text", "page_paths", "nodes", *[b.alias(n) for b, n in zip(base, names, strict=True)]]


def _rows_at(spec: RelationSpec, base: Column) -> Column:
    """The numbered elements of a page's table, in order: struct(row_no, cells), a cell for each column, null where it is missing."""
    head, _, tail = spec.row_selector.partition("[*]")
    tag, below = head.rpartition("/")[2], pages.steps_of(tail)

    def row(n: Column) -> Column:
        cells = pages.once(pages.child_at(n, below), lambda top: F.array(*[pages.child_at(top, pages.steps_of(p)) for p in spec.columns.values()]))
        return F.struct(n["nth"].alias("row_no"), cells.alias("cells"))

    if head.rpartition("/")[0]:
        rows = F.filter(F.slice(F.col("nodes"), base["n"] + 2, base["last"] - base["n"]), lambda n: (n["parent"] == base["n"]) & (n["tag"] == tag))
    else:
        rows = F.filter("nodes", lambda n: n["parent"].isNull() & (n["tag"] == tag))
    return F.transform(rows, row)


def _whole(row: Column) -> Column:
    return F.forall(row["cells"], lambda c: c.isNotNull())


def _cells(nodes: DataFrame, spec: RelationSpec) -> DataFrame:
    """(page_id, row_no, column, text, link) of every cell that the spec selects."""
    names = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")) for c, p in spec.columns.items()])
    head = spec.row_selector.partition("[*]")[0]
    placed = nodes.where(F.startswith("xpath", F.lit(head + "["))).select("page_id", _row_no(spec).alias("row_no"), _below(spec).alias("rest"), "text", "link").where("row_no is not null")
    return placed.select("page_id", "row_no", F.explode(F.filter(names, lambda n: n.p == F.col("rest"))).alias("n"), "text", "link").select("page_id", "row_no", F.col("n.c").alias("column"), "text", "link")


def extract_rows(nodes: DataFrame, spec: RelationSpec) -> DataFrame:
    """page_id, row_idx (from 1) and <column>_text, <column>_link for each row of the table; missing cells are empty.

    `nodes` is a layout of pages or rows of elements. In a layout a table's rows stand side by side below one element, so rows come out page by page
    without a shuffle, and texts and links are made for their cells only; of rows of elements, one exchange by page and row (no pivot job) puts the cells together.
    """
    if "nodes" in nodes.columns:
        found = F.filter(_rows_at(spec, F.col("_rl_base0")), lambda r: F.exists(r["cells"], lambda c: c.isNotNull()))
        get = lambda r, k, f: F.coalesce(f(F.get(r["cells"], F.lit(k))), F.lit(""))
        rows = F.transform(found, lambda r: F.struct(*[get(r, k, f).alias(f"{c}_{what}") for k, c in enumerate(spec.columns) for what, f in (("text", pages.text_of), ("link", pages.link_of))]))
        numbered = nodes.select(*_with_base([spec])[1]).select("page_id", F.posexplode(rows).alias("_rl_i", "_rl_r")).select("page_id", (F.col("_rl_i") + 1).cast("long").alias("row_idx"), "_rl_r.*")
        return exclude_first(numbered, spec.exclude_first) if spec.exclude_first else numbered
    values = [f(F.when(F.col("column") == c, F.col(k))).alias(f"{c}_{k}") for c in spec.columns for k, f in (("text", F.max), ("link", F.max))]
    rows = _cells(nodes, spec).groupBy("page_id", "row_no").agg(*values)
    cells = [blank(f"{c}_{k}").alias(f"{c}_{k}") for c in spec.columns for k in ("text", "link")]
    numbered = rows.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("row_no")).cast("long").alias("row_idx"), *cells)
    return exclude_first(numbered, spec.exclude_first) if spec.exclude_first else numbered


def exclude_first(rows: DataFrame, n: int) -> DataFrame:
    """Without the first n rows of each page; the others are numbered anew."""
    return rows.where(F.col("row_idx") > n).withColumn("row_idx", F.col("row_idx") - n)


def preview(rows: DataFrame, order: Sequence[str], k: int = 3) -> DataFrame:
    """The first k rows as text, and a row of "..." if there are more."""
    cols = rows.columns
    head = rows.orderBy(*order).limit(k).select(*[blank(c).alias(c) for c in cols], *[F.col(c).alias(f"_rl_o{i}") for i, c in enumerate(order)])
    dots = rows.orderBy(*order).limit(k + 1).agg(F.count("*").alias("n")).where(F.col("n") > k).select(*[F.lit("...").alias(c) for c in cols])
    return head.select(*cols).unionByName(dots)


def output_preview(rows: DataFrame, run: str, order: Sequence[str], k: int = 100) -> DataFrame:
    """The first k rows of each run; ranks are cut off before the exchange."""
    rank = F.row_number().over(Window.partitionBy(run).orderBy(*order))
    return rows.withColumn("_rl_rank", rank).where(F.col("_rl_rank") <= k).drop("_rl_rank")


def rename(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """New names for columns; those of a relation are given with or without _text and _link."""
    full = {f"{a}{s}": f"{b}{s}" for a, b in names.items() for s in ("", "_text", "_link")}
    return rows.withColumnsRenamed({a: b for a, b in full.items() if a in rows.columns})


def default_names(relation: int, columns: int) -> list[str]:
    return [f"relation_{relation}_item_{k}" for k in range(1, columns + 1)]


def edit_cells(cells: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """A column's nodes (page_id, xpath, ...) without the removed ones, with the added ones."""
    if remove is not None:
        cells = cells.join(remove.select("page_id", "xpath").distinct(), ["page_id", "xpath"], "left_anti")
    return cells if add is None else cells.unionByName(add.join(cells.select("page_id", "xpath"), ["page_id", "xpath"], "left_anti"))


def suggest_names(specs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The name most often given before to a table of the same site and selector; ties by name; null if it is new."""
    used = catalogue.groupBy("site", "row_selector", F.col("name").alias("suggested")).agg(F.count("*").alias("uses"))
    best = first_by(used, ["site", "row_selector"], [F.desc("uses"), "suggested"]).select("site", "row_selector", "suggested")
    return specs.join(best, ["site", "row_selector"], "left")


def extract_relations(nodes: DataFrame, specs: Sequence[RelationSpec]) -> dict[str, DataFrame]:
    """Several tables of the same pages."""
    return {s.name: extract_rows(nodes, s) for s in specs}


def specs_frame(spark: SparkSession, specs: Sequence[RelationSpec]) -> DataFrame:
    return spark.createDataFrame([(s.name, s.row_selector, dict(s.columns), s.exclude_first) for s in specs], "name string, row_selector string, columns map<string,string>, exclude_first int")


def cell(text: Column, link: Column) -> Column:
    return F.struct(blank(text).alias("text"), link.alias("link"))
