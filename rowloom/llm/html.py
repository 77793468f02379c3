"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is one sequence of words and tags. Words score positive, tags negative; the content region is
the contiguous run with the largest sum, found in one linear scan. The weights come from labelled
pages: pages whose only <article> (or <main>) element marks the content. Each tag's weight is its
log-odds of standing inside the content against outside, smoothed towards that of its kind (inline elements near
nothing, block elements a little below), so that a tag the labelled pages do not have costs less than a word; clear ones are taken times a scale that is
chosen on the same pages, with half of the kinds of tags hidden as well. Words and tags of elements that are never content (menus, forms, scripts,
notices and the like) score a little below nothing, so that the region can reach across them, and are left out of its text.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
NOISE = RAW | frozenset("nav aside footer form button select option dialog menu canvas object audio video head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Site headers are noise, headers of articles are not.
HEADERS = frozenset(["header"])
# Parts of names in class, id and role of block elements that mark menus, adverts, notices and reader comments; what may follow them in a name; first parts that speak of the whole page.
MARKS = re.compile(r"ad|ads|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|sharing|social|related|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|disqus|respond|contentinfo|complementary|search", re.I)
FOLLOW = re.compile(r"\d*|links?|buttons?|btns?|bar|box|boxes|block|widgets?|list|section|menu|form|items?|left|right|top|bottom|posts?|articles|stories|icons?|slot|unit|banner|notice|panel|overlay|signup|area|thread|respond|primary|secondary|media|share|footer", re.I)
WHOLE = re.compile(r"has|no|with|without|is|not|wp", re.I)

#: A whole tag: a quote matters only where a value begins. Nothing is tried twice.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>", re.S)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Weights:
    """What training learns. `tags` has names like "p" and "/p"; `other` is for unseen tags."""

    word: float = 1.0
    noise_word: float = -0.1
    scale: float = 4.0
    tags: dict[str, float] = field(default_factory=lambda: {t: -6.0 for x in ("article", "main", "body", "html") for t in (x, f"/{x}")})

    def tag(self, name: str) -> float:
        w = self.tags.get(name)
        if w is None:
            return prior(name)
        return w if w > -1 else w * self.scale


def prior(name: str) -> float:
    """The weight of a tag that no labelled page has."""
    return -0.05 if name.lstrip("/") in INLINE else -0.6


def marked(attributes: str) -> bool:
    """Whether a name in class, id or role marks noise: a mark as its last part, or as its first with parts that may follow it.

    So `main-sidebar` and `share-buttons` are marks, `content-sidebar-wrap`, `has-sidebar` and `social-science` are not.
    """
    for a, b, c in _ATTRIBUTE.findall(attributes):
        for name in (a or b or c).split():
            parts = [x for x in re.split(r"[-_]+", name) if x]
            if not parts or WHOLE.fullmatch(parts[0]):
                continue
            if MARKS.fullmatch(parts[-1]) or MARKS.fullmatch(parts[0]) and all(FOLLOW.fullmatch(x) for x in parts[1:]):
                return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(kind, value, noise): kind "t" for text between tags, else "<" with the tag's name ("/p"). Time is linear in the page.

    As in browsers, a tag or comment that is not closed before the page ends is dropped with all that follows, an element that is not closed
    ends with the page, and a paragraph ends where a block begins. An element that holds an
    article is noise before and after it only; a marked one or a form that holds nearly all of the page's words is none.
    """
    out: list[tuple[str, str, bool]] = []
    open_tags: list[tuple[str, int, int]] = []
    counts: Counter = Counter()
    spans: list[tuple[int, int, int]] = []
    contents: list[int] = []
    content_ends: list[int] = []

    def shut(k: int, end: int) -> None:
        content_ends.extend(end for name, *_ in open_tags[k:] if name in ("article", "main"))
        spans.extend((start, end, noise) for _, start, noise in open_tags[k:] if noise)
        counts.subtract(t[0] for t in open_tags[k:])
        del open_tags[k:]

    at, text, size = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        first = page[at + 1 : at + 2]
        if not (first.isascii() and first.isalpha() or first in ("!", "?") or first == "/" and page[at + 2 : at + 3].isascii() and page[at + 2 : at + 3].isalpha()) or not first:
            at += 1  # no markup
            continue
        if at > text:
            out.append(("t", page[text:at], False))
        if first in ("!", "?"):
            end, skip = (page.find("-->", at + 2), 3) if page.startswith("<!--", at) else (page.find(">", at), 1)
            at = text = end + skip if end >= 0 else size
            continue
        m = _TAG.match(page, at)
        if m is None:
            at = text = size
            break
        at = text = m.end()
        name = m[2].lower()
        if m[1]:
            out.append(("<", f"/{name}", False))
            if counts[name]:
                shut(next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name), len(out))
            continue
        # 1: by its kind, 2: unless it holds most words
        held = counts["article"] or counts["main"]
        if name in ("article", "main"):
            contents.append(len(out))
        noise = 2 if name == "form" else 1 if name in NOISE or name in HEADERS and not held else 0
        if not noise and name not in INLINE and name not in ("html", "body", "article", "main") and marked(m[3]):
            noise = 2
        if name in RAW:
            end = _ENDS[name].search(page, at)
            out += [("<", name, True), ("<", f"/{name}", True)]
            at = text = end.end() if end else size
            continue
        if name not in INLINE and counts["p"]:
            k = len(open_tags) - 1
            while open_tags[k][0] != "p" and open_tags[k][0] in INLINE:
                k -= 1
            if open_tags[k][0] == "p":
                shut(k, len(out))
        out.append(("<", name, noise == 1 and name not in HEADERS and name in VOID))
        if name not in VOID and not m[3].endswith("/"):
            open_tags.append((name, len(out) - 1, noise))
            counts[name] += 1
    if text < size:
        out.append(("t", page[text:], False))
    shut(0, len(out))
    if spans:
        words = list(accumulate((len(v.split()) if kind == "t" else 0 for kind, v, _ in out), initial=0))
        steps = [0] * (len(out) + 1)
        for a, b, kind in spans:
            if kind == 2 and words[b] - words[a] > 0.85 * words[-1]:
                continue
            n = bisect.bisect_left(contents, a)
            if n < len(contents) and contents[n] < b:
                # only what stands before and after the article
                for x, y in ((a, contents[n]), (content_ends[bisect.bisect_right(content_ends, b) - 1], b)):
                    steps[x] += 1
                    steps[y] -= 1
                continue
            steps[a] += 1
            steps[b] -= 1
        inside = accumulate(steps)
        out = [(kind, value, True) if n > 0 else (kind, value, noise) for (kind, value, noise), n in zip(out, inside, strict=False)]
    return out


def blocks(found: list[tuple[str, str, bool]], start: int, end: int) -> list[str]:
    """The text blocks of tokens[start:end], without noise; white space is one space."""
    out, run = [], []
    for kind, value, noise in found[start:end]:
        if kind == "t":
            if not noise:
                run.append(value)
        elif value.lstrip("/") == "br":
            run.append(" ")
        elif value.lstrip("/") not in INLINE:
            out.append("".join(run))
            run = []
    out.append("".join(run))
    return [t for b in out if (t := " ".join(entities.unescape(b).split()))]


def region(found: list[tuple[str, str, bool]], w: Weights) -> tuple[int, int]:
    """Start and end of the run of tokens with the largest sum; the first of equals; (0, 0) if none is positive."""
    best, total, start, where = 0.0, 0.0, 0, (0, 0)
    for k, (kind, value, noise) in enumerate(found):
        if kind == "t":
            n = len(value.split())
            total += n * (w.noise_word if noise else w.word)
        else:
            total += w.noise_word if noise else w.tag(value)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, where = total, (start, k + 1)
    return where


def extract(page: str | None, w: Weights) -> str:
    found = tokens(page or "")
    return "\n".join(blocks(found, *region(found, w)))


def labelled(found: list[tuple[str, str, bool]]) -> tuple[int, int] | None:
    """The content that a page labels itself: inside its only <article>, or else its only <main>."""
    for name in ("article", "main"):
        starts = [k for k, t in enumerate(found) if t[:2] == ("<", name)]
        ends = [k for k, t in enumerate(found) if t[:2] == ("<", f"/{name}")]
        if len(starts) == len(ends) == 1 and starts[0] < ends[0]:
            return starts[0] + 1, ends[0]
    return None


SCALES = (4.0, 8.0, 16.0, 32.0, 64.0)
#: How many labelled occurrences a tag's kind counts for.
SMOOTH = 5.0


def train(pages: DataFrame, html_col: str = "html", id_col: str = "url", sample: int = 2000) -> Weights:
    """Weights from about `sample` pages (the bound of the fit), picked by a hash of their ids.

    Counting and the choice of the scale run as Spark jobs; only counts by tag come to the driver: of the tags that the sample has
    twice at least, others keep the weight of their kind. Without a labelled page, and for an empty table, the built-in weights stay.
    """
    n = pages.count()
    if not n:
        return Weights()
    rank = F.pmod(F.xxhash64(F.col(id_col), F.lit("pages")), F.lit(1_000_000)) / 1e6
    some = pages.where(rank < min(1.0, sample / n)).where(F.col(html_col).isNotNull()).select(F.col(html_col).cast("string").alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = tokens(page)
                if (span := labelled(found)) is None:
                    continue
                for k, (kind, value, noise) in enumerate(found):
                    if noise:
                        continue
                    key = ("<" + value) if kind == "<" else "word"
                    c[key, span[0] <= k < span[1]] += 1 if kind == "<" else len(value.split())
        keys = list(c)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([c[k] for k in keys], pa.int64())], names=["key", "inside", "n"])

    rows = some.mapInArrow(count, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n")).where("n > 1").collect()
    counts = {(r.key, r.inside): r.n for r in rows}
    if not any(inside for _, inside in counts):
        return Weights()

    def odds(key: str, inside: float) -> float:
        return math.log((counts.get((key, True), 0) + SMOOTH * inside) / (counts.get((key, False), 0) + SMOOTH * (1 - inside)))

    tags = {k[1:]: min(-0.05, odds(k, 1 / (1 + math.exp(-prior(k[1:]))))) for k, _ in counts if k != "word"}
    weights = Weights(word=min(max(1.0, odds("word", 0.5)), 4.0), noise_word=-0.1, tags=tags)
    hidden = Weights(weights.word, weights.noise_word, tags={t: v for t, v in tags.items() if v <= -1 or zlib.crc32(t.lstrip("/").encode()) % 2})

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = dict.fromkeys(SCALES, 0)
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found = tokens(page)
                if (span := labelled(found)) is None:
                    continue
                want = blocks(found, *span)
                for s in SCALES:
                    weights.scale = hidden.scale = s
                    hits[s] += sum(blocks(found, *region(found, w)) == want for w in (weights, hidden))
        yield pa.RecordBatch.from_arrays([pa.array(list(hits), pa.float64()), pa.array(list(hits.values()), pa.int64())], names=["scale", "n"])

    best = some.mapInArrow(exact, "scale double, n long").groupBy("scale").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "scale").first()
    weights.scale = best.scale if best else SCALES[0]
    return weights


def main_text(pages: DataFrame, weights: Weights, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with `out_col`, the page's main text: blocks joined by a newline, empty if none.

    Null, empty and broken pages never fail: unclosed elements end with their parents, an unclosed
    script, comment or tag runs to the end. Rows stay one to one, repeated ones too; an empty table gives no rows. Other columns
    pass through; a clashing one is replaced.
    """

    def run(found: list) -> list:
        return [[extract(p, weights) for p in found]]

    return map_columns(pages, [html_col], [T.StructField(out_col, T.StringType())], run)
