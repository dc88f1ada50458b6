"""Main text of web pages by a maximum-scoring subsequence.

A page becomes a sequence of tags and blocks of words. Words score by where they
stand (kind of block, inside a link or not), tags by name; scores are log-odds of
lying in the main text, counted on labelled pages: those whose markup names one
article or main element. One linear scan finds the contiguous region with the
greatest sum.

Elements whose tag, role, class or id is that of other matter (menus, asides,
adverts, notices, comments) are boxes. A box is judged by its own sum: its words'
scores, lowered by what its marks weigh, less a fixed cost; the marks' weights are
log-odds from the labelled pages, or priors for marks that those don't have. Long
prose in a box with a doubtful mark so stays, and a box that goes hardly counts for
the scan, so that one in mid-article doesn't cut it in two. Forms, scripts, styles
and hidden elements go whatever their sum.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import boxed, pieces_by_bytes, released, table, unboxed, whole

#: Labelled pages that the weights are counted on, in expectation.
SAMPLE_PAGES = 2_000
SLICE_BYTES = 4 << 20
#: Without labelled pages: a word's and a tag's score.
PRIOR = {"word": 1.0, "tag": -3.25}
#: Of a block in a box of other matter, whatever its length.
BOX_SCORE = -0.5
BOX_TAG = -0.1
#: Of tags that no labelled page has; within the one main element that a page names, tags cost less and words count at least so much.
UNSEEN_TAG = -1.0
INNER_TAG = -0.1
INNER_WORD = 0.3

#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template textarea title iframe select noembed noframes".split())
#: Among them form fields, which stand in a line of text.
_RAW_INLINE = frozenset(("textarea", "select"))
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img input button math mi mn mo mrow msup msub mtext svg text tspan object canvas output meter progress".split())
_CONTAINERS = frozenset("article aside body center details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
#: Elements whose content goes unseen.
_GONE_TAGS = frozenset("form head".split())
#: How much of a word's score a mark takes, without labelled pages: doubtful marks leave some, sure ones turn it round.
DOUBTFUL, SURE, MOST = 0.6, 1.6, 3.0
#: What a box must outweigh.
BOX_COST = 8.0
_BOX_TAGS = {"nav": SURE, "aside": SURE, "menu": SURE, "header": SURE, "footer": SURE, "dialog": DOUBTFUL}
#: The same within an article or main element.
_INNER_TAGS = {"nav": SURE, "aside": SURE, "menu": SURE, "footer": DOUBTFUL, "dialog": DOUBTFUL}
_ROLES = {x: SURE for x in "navigation banner contentinfo complementary menu menubar toolbar".split()} | {x: DOUBTFUL for x in "search dialog alert alertdialog".split()}
_SURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo sidebar menu navbar nav navigation breadcrumb breadcrumbs masthead topbar cookie cookies consent gdpr popup newsletter comment comments commentlist disqus replies respond pagination pager".split()
)
_DOUBTFUL_WORDS = frozenset("banner header footer notice notification alert modal overlay subscribe signup login search share sharing social related recommended widget toolbar tag tags disclaimer legal copyright".split())
#: Words that may stand beside those in one name.
_BESIDE = frozenset("list box bar area block wrap wrapper container section site page top bottom items item links form main primary secondary global row panel".split())
#: The marks of a page's head, but for an article's own one within it.
_HEAD_WORDS = frozenset(("header", "masthead", "topbar", "banner"))
#: Pages of the sample that must hold a class or id for its weight to count, at least this share: so their number doesn't grow with the pages.
LEAST_SHARE = 0.01
#: Tags whose counts are kept apart; all others count as one.
_COUNTED = frozenset("p br hr h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address figcaption summary legend option optgroup head link meta base picture source svg path math button object canvas video audio param embed area map col colgroup".split())
_CLASS = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?([\w-]+)""", re.I)
_OPEN = re.compile(r"(?:^|\s)open(?=[\s=/]|$)", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def _prior(token: str, within: bool) -> float:
    """What a class or id takes: a name of words of other matter, all of them, but for words like list and box."""
    words = [w for w in re.split(r"[_-]+", token) if w]
    named = [w for w in words if w in _SURE_WORDS or w in _DOUBTFUL_WORDS]
    if not named or any(w not in _BESIDE for w in words if w not in named) or within and any(w in _HEAD_WORDS for w in named):
        return 0.0
    return SURE if any(w in _SURE_WORDS for w in named) else DOUBTFUL


def marks_of(name: str, attributes: str, within: bool) -> tuple[tuple[str, float], ...] | None:
    """(mark, prior) of an element; None if it goes whatever it holds."""
    if name in _GONE_TAGS or attributes and _HIDDEN.search(attributes) or name == "dialog" and not _OPEN.search(attributes):
        return None
    out = []
    tags = _INNER_TAGS if within else _BOX_TAGS
    if name in tags:
        out.append((f"{'inner' if within else 'box'}:{name}", tags[name]))
    if name in ("article", "main", "body", "html") or not attributes:
        return tuple(out)
    role = _ROLE.search(attributes)
    if role:
        if role[1].lower() == "form":
            return None
        out.append((f"role:{role[1].lower()}", _ROLES.get(role[1].lower(), 0.0)))
    for m in _CLASS.finditer(attributes):
        for token in next((x for x in m.groups() if x), "").lower().split()[:20]:
            out.append((f"class:{token[:40]}", _prior(token, within)))
    return tuple(out)


def tokens_of(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """("text", raw, False, "") and ("tag", name, closing, attributes) and ("raw", name, False, "") in page order, in time linear in the page.

    Every kind of end is looked for at most once where there is none; after a tag
    whose quotes never close, quotes no longer hide a >.
    """
    none: set[str] = set()  # ends that don't come any more
    quotes, at, size = True, 0, len(page)

    def after(end: str, start: int) -> int:
        if end in none:
            return size
        hit = page.find(end, start)
        if hit < 0:
            none.add(end)
            return size
        return hit + len(end)

    def after_raw(name: str, start: int) -> int:
        hit = None if name in none else _RAW_END[name].search(page, start)
        if hit is None:
            none.add(name)
            return size
        return after(">", hit.end())

    while at < size:
        here = page.find("<", at)
        if here < 0 or here + 1 == size:
            yield "text", page[at:], False, ""
            return
        tag = _TAG.match(page, here) if quotes else None
        if tag:
            if here > at:
                yield "text", page[at:here], False, ""
            slash, name, attributes = tag.groups()
            name = name.lower()
            at = tag.end()
            if name not in _RAW or slash:
                yield "tag", name, slash == "/", attributes
                continue
            yield "raw", name, False, ""
            at = after_raw(name, at)
            continue
        if page.startswith("<!--", here):
            stop = min(after("-->", here + 4), after("--!>", here + 4))
        elif page.startswith("<![CDATA[", here):
            stop = after("]]>", here)
        elif page[here + 1] in "!?":
            stop = after(">", here)
        else:
            m = _NAME.match(page, here)
            if not m:
                if page[here + 1] != "/":
                    yield "text", page[at : here + 1], False, ""
                    at = here + 1
                    continue
                stop, name = after(">", here), ""
            else:
                name = m[1].lower()
                quotes = False  # as _TAG doesn't match
                stop = after(">", m.end())
            if here > at:
                yield "text", page[at:here], False, ""
            if name:
                yield "tag", name, page[here + 1] == "/", page[m.end() : stop].removesuffix(">")
            at = stop
            continue
        if here > at:
            yield "text", page[at:here], False, ""
        at = stop


def items_of(page: str) -> tuple[list[tuple], list[tuple[tuple[str, float], ...]], int]:
    """("tag", name, owners, gone, within) and ("block", text, kind, owners, gone, within) in page order, the marks of the elements that owners number, and the number of article and main elements."""
    out: list[tuple] = []
    marked: list[tuple[tuple[str, float], ...]] = []
    stack: list[tuple[str, tuple[int, ...], bool]] = []
    parts: list[str] = []
    owners: tuple[int, ...] = ()
    kind, gone, link, linked, chars, within, mains = "body", 0, 0, 0, 0, 0, 0

    def text(raw: str) -> None:
        nonlocal linked, chars
        if raw:
            parts.append(raw)
            n = len(raw) - raw.count(" ")
            chars += n
            if link:
                linked += n

    def end() -> None:
        nonlocal parts, linked, chars
        if parts:
            block = " ".join(html.unescape("".join(parts)).split())
            if block:
                out.append(("block", block, f"{kind}{'+a' if 2 * linked > chars else ''}", owners, gone > 0, within > 0))
            parts, linked, chars = [], 0, 0

    open_: Counter = Counter()
    for sort, name, closing, attributes in tokens_of(page):
        if sort == "text":
            text(name)
            continue
        if sort == "raw":
            if name not in _RAW_INLINE:
                end()
            continue
        if name == "a":
            link = 0 if closing else 1
        if name in _INLINE:
            continue
        end()
        mark = len(out)
        kept_name = name if name in _COUNTED or name in _CONTAINERS else "other"
        out.append(("tag", kept_name, owners, gone > 0, within > 0))
        if name not in _CONTAINERS:
            kind = "body" if closing else kept_name
            if name != "br":
                link = 0
            continue
        link, kind = 0, name if not closing else "body"
        if not closing:
            mains += name in ("article", "main")
            if not attributes.rstrip().endswith("/"):
                marks = marks_of(name, attributes, within > 0)
                stack.append((name, owners, marks is None))
                open_[name] += 1
                gone += marks is None
                if marks:
                    owners = (*owners, len(marked))
                    marked.append(marks)
                within += name in ("article", "main")
                out[mark] = ("tag", kept_name, owners, gone > 0, within > 0)
        elif open_[name]:
            while True:
                n, owners, went = stack.pop()
                open_[n] -= 1
                gone -= went
                within -= n in ("article", "main")
                if n == name:
                    break
    end()
    return out, marked, mains


def _takes(marks: tuple[tuple[str, float], ...], weights: dict[str, float]) -> float:
    """The most that one of an element's marks takes of a word's score. Labelled pages clear a doubtful mark, and raise any."""
    most = 0.0
    for mark, prior in marks:
        odds = weights.get(mark)
        most = max(most, prior if odds is None else min(MOST, -odds) if -odds > prior else prior if prior >= SURE or odds < 0 else 0.0)
    return most


def judged(items: list[tuple], marked: list[tuple[tuple[str, float], ...]], mains: int, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """Every item's score, and whether it goes with its box.

    Where the page names one main element, words outside count against and tags
    inside cost little. A box is the outermost element with a mark that takes something.
    """
    word, tag = PRIOR["word"], UNSEEN_TAG if weights else PRIOR["tag"]
    takes = [_takes(m, weights) for m in marked]
    box_of = [next((o for o in x[-3] if takes[o] > 0), None) for x in items]
    scores = []
    for x in items:
        if x[0] == "tag":
            score = weights.get(f"tag:{x[1]}", tag)
            scores.append(max(score, INNER_TAG) if mains == 1 and x[4] else score)
            continue
        score = weights.get(f"word:{x[2]}", word if not x[2].endswith("+a") else -word)
        if mains == 1:
            score = max(score, INNER_WORD) if x[5] else -word
        taken = max((takes[o] for o in x[3]), default=0.0)
        scores.append((x[1].count(" ") + 1) * (score * (1 - taken) if score > 0 else score))
    sums: dict[int, float] = {}
    for x, box, score in zip(items, box_of, scores, strict=True):
        if box is not None and x[0] == "block" and not x[4]:
            sums[box] = sums.get(box, -BOX_COST) + score
    goes = [x[-2] or box is not None and sums.get(box, -BOX_COST) <= 0 for x, box in zip(items, box_of, strict=True)]
    return [(BOX_TAG if x[0] == "tag" else BOX_SCORE) if g else s for x, g, s in zip(items, goes, scores, strict=True)], goes


def best_region(scores: list[float]) -> tuple[int, int]:
    """[low, high) of the greatest positive sum; the first and shortest such. (0, 0) if none is positive."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(page: str, weights: dict[str, float]) -> str:
    items, marked, mains = items_of(page)
    scores, goes = judged(items, marked, mains, weights)
    low, high = best_region(scores)
    return "\n".join(x[1] for x, g in zip(items[low:high], goes[low:high], strict=True) if x[0] == "block" and not g)


def count_labels(page: str) -> Counter:
    """Counts of words and tags in and out of the labelled element, and pages by mark; none without exactly one."""
    out: Counter = Counter()
    items, marked, mains = items_of(page)
    if mains != 1:
        return out
    boxed_ = [any(prior for _, prior in m) for m in marked]
    plain = [not x[-2] and not any(boxed_[o] for o in x[-3]) for x in items]
    inside = [i for i, x in enumerate(items) if x[0] == "block" and x[5] and plain[i]]
    if not inside:
        return out
    seen = set()
    for i, x in enumerate(items):
        here = "in" if inside[0] <= i <= inside[-1] else "out"
        if x[0] == "tag":
            if plain[i]:
                out[f"tag:{x[1]}", here] += 1
        elif not x[4]:
            n = x[1].count(" ") + 1
            if plain[i]:
                out[f"word:{x[2]}", here] += n
            for mark in {m for o in x[3] for m, _ in marked[o]}:
                seen.add(mark)
                if not mark.startswith("inner:"):  # the label can't tell these
                    out[mark, "in" if x[5] else "out"] += n
    for mark in seen:
        out[mark, "pages"] += 1
    return out


def fit(counts: dict[tuple[str, str], int]) -> dict[str, float]:
    """Log-odds of lying in the main text: words within 0.1 to 1 either side of 0; tags at most 0; marks within MOST."""
    out: dict[str, float] = {}
    for name in {k for k, _ in counts}:
        odds = math.log((counts.get((name, "in"), 0) + 1) / (counts.get((name, "out"), 0) + 1))
        if name.split(":")[0] in ("box", "inner", "role", "class"):
            if counts.get((name, "in"), 0) + counts.get((name, "out"), 0):
                out[name] = max(-MOST, min(MOST, odds))
        elif name.startswith("word:"):
            out[name] = math.copysign(min(1.0, max(0.1, abs(odds))), odds)
        else:
            out[name] = min(0.0, max(PRIOR["tag"], odds - 0.1))
    return out


def learn(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from a sample by hash of the id, so rows of one id are in it together; what reaches the driver is a count for each kind of block, tag, and mark of LEAST_SHARE of the sample."""
    total = pages.count()
    if not total:
        return {}
    some = pages.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < max(1, math.ceil(1_000_000 * min(1.0, sample / total)))).select(whole(F.col(html_col)).alias("_html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found.update(count_labels(page))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["name", "here", "n"])

    rows = some.mapInArrow(count, "name string, here string, n bigint").groupBy("name").agg(*[F.sum(F.when(F.col("here") == x, F.col("n")).otherwise(0)).alias(x) for x in ("in", "out", "pages")])
    least = max(2.0, LEAST_SHARE * min(sample, total))
    rows = rows.where(~F.col("name").startswith("class:") & ~F.col("name").startswith("role:") | (F.col("pages") >= least)).collect()
    return fit({(r["name"], x): r[x] for r in rows for x in ("in", "out") if r[x]})


def extract_text(pages: DataFrame, html_col: str = "html", weights: dict[str, float] | None = None, id_col: str = "page_id") -> DataFrame:
    """Every row without html_col, with text and n_chars; columns of these names are replaced.

    A null or empty page, or one without a region of positive sum, has the empty
    text. Pages are judged one by one, so repeated rows are no matter; other columns,
    whatever their names, pass through; an empty frame gives none. An unclosed tag,
    comment or script reaches to the end of the page.
    """
    ship(pages.sparkSession)
    learned = learn(pages, html_col, id_col) if weights is None else weights
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    ready = pages.select(boxed(pages, html_col, "text", "n_chars"), whole(F.col(f"`{html_col}`")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for y in batches for x in pieces_by_bytes(y, "html", SLICE_BYTES)):
            texts = [main_text(x, learned) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])
        released()

    out = ready.mapInArrow(run, T.StructType([ready.schema["row"]]).add("text", "string").add("n_chars", "long"))
    return out.select(*unboxed(keep), "text", "n_chars")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text: page_id, url, text, n_chars.

    A null or empty page has the empty text; repeated rows stay; an empty table gives
    none. Of regions with equal sums the first and shortest counts.
    """
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
