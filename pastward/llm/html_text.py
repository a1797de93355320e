"""Main text of web pages by a maximum-scoring stretch of words and tags.

A page is a sequence of words and tags. Words score positive and tags negative, by the log-odds of lying inside the article,
learned from pages that mark it themselves (exactly one ``article`` or ``main`` element) in a sample of at most
``SAMPLE`` pages picked by a hash. A linear scan finds the stretch with the greatest sum. Elements that are never part
of an article (menus, forms, scripts, adverts, comments and so on, by element name, role or class) are taken
out first and score as one tag. A class or id doesn't take out headings, paragraphs, what is or holds an ``article`` or
``main`` element, nor what holds most of the words of the page. If the stretch lies in an ``article`` or ``main`` element, it is widened to that element's ends.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import out_batch, rows_of

SAMPLE = 2_000
LEAST_WORD, MOST_WORD = 0.05, 3.0
LEAST_TAG, MOST_TAG = -2.0, -0.01
FORBIDDING = -8.0
ASIDE_SCORE = -2.0

# HTML element names by their role here.
_RAW = "script style noscript template iframe textarea title svg canvas object"
_ASIDE = set("nav footer aside form button select head menu dialog datalist audio video".split())
_MARKS = {"article", "main"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_KNOWN = _INLINE | _VOID | _ASIDE | _MARKS | set(
    "address blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup html legend li ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
_ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside "
    "footer masthead comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup social share sharing related recommended recommendations widget toolbar pagination pager login search skip "
    "copyright disclaimer alert paywall teaser".split())
#: Of these, those that articles are about too: they count in names whose other parts are from the lists here, 'share-buttons' but not 'share-price'.
_TOPICS = set("advertising aside promotion navigation discussion reply replies notice notices notification newsletter social share sharing related recommended recommendations search disclaimer alert".split())
_FURNITURE = set(
    "area article articles bar block body bottom box btn button buttons col column container content entry float follow form group header icon icons inner item items js "
    "left link links list main media module more outer page panel pane post posts right row section site stories story text title top wrap wrapper".split())
_COMMENTS = set("comment comments commentlist respond reply replies disqus".split())
_NEGATING = {"no", "has", "have", "with", "without", "hide"}
_TEXT_BLOCKS = set("h1 h2 h3 h4 h5 h6 p".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(_RAW.split())})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b", re.I)
_NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")


def _aside_words(names: str) -> set[str]:
    """Words in the names of a class or id that mean it is never part of an article; 'no-sidebar' and 'has-comments' have none."""
    found = set()
    for name in names.split():
        parts = [p.lower() for p in _NAME_PART.findall(name)]
        cut = next((k for k, p in enumerate(parts) if p in _NEGATING), len(parts))
        words = _ASIDE_WORDS.intersection(parts[:cut])
        if words - _TOPICS or all(p in _ASIDE_WORDS or p in _FURNITURE for p in parts[:cut]):
            found |= words
    return found


class Page:
    """Tokens of a page: (kind, value) with kind 'text', 'open' or 'close'; ``end`` has the close of each open tag."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, str]] = []
        self.end: dict[int, int] = {}
        self._totals: tuple[list[tuple[int, bool]], list[int]] | None = None
        opened: dict[str, list[int]] = {}
        for raw, slash, name, attributes, text in (m.groups() for m in _TOKEN.finditer(source)):
            if text is not None:
                self.tokens.append(("text", text, ""))
            elif name is not None:
                name = name.lower()
                if slash:
                    if opened.get(name):
                        self.end[opened[name].pop()] = len(self.tokens)
                    self.tokens.append(("close", name, ""))
                else:
                    if name not in _VOID and not attributes.endswith("/"):
                        opened.setdefault(name, []).append(len(self.tokens))
                    self.tokens.append(("open", name, attributes))

    def marks(self) -> list[int]:
        """Places of the elements that mark an article."""
        return [i for i, (kind, name, attributes) in enumerate(self.tokens) if kind == "open" and name in _MARKS and not self._aside(i, False)]

    def _aside(self, place: int, inside: bool) -> bool:
        """Whether an element is never part of an article; ``inside``: of an element that marks one."""
        _, name, attributes = self.tokens[place]
        if name in _ASIDE or name == "header" and not inside:
            return True
        if name in ("html", "body") or "=" not in attributes and "hidden" not in attributes:
            return False
        for key, value, hidden in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if hidden or key == "role" and value.lower() in _ASIDE_ROLES or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "style" and "display:none" in value.replace(" ", "").lower():
                return True
            if key in ("class", "id") and name not in _TEXT_BLOCKS:
                found = _aside_words(value)
                if inside and name == "section" and key == "id":
                    found -= _TOPICS
                if found and not self._holds_article(place, found):
                    return True
        return False

    def _holds_article(self, place: int, found: set[str]) -> bool:
        """Whether an element with these words in its names is or holds an article or main element, or most words of the page.

        Articles that are comments by their own names count only where the page has no other.
        """
        if self._totals is None:
            marks, words = [], [0]
            for i, (kind, value, attributes) in enumerate(self.tokens):
                words.append(words[-1] + (len(value.split()) if kind == "text" else 0))
                if kind == "open" and value in _MARKS:
                    names = " ".join(v.strip("\"'") for k, v, _ in _ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id"))
                    marks.append((i, not _COMMENTS.isdisjoint(_aside_words(names))))
            self._totals = marks, words
        marks, words = self._totals
        end = self.end.get(place, place)
        within = [comment for i, comment in marks if place <= i <= end]
        if within and (len(within) == len(marks) or not all(within)):
            return True
        if marks and not _COMMENTS.isdisjoint(found):
            return False
        return 2 * (words[end] - words[place]) > words[-1]

    def pieces(self):
        """(place, class, words or None) in page order, elements never in an article as one piece of class 'aside'."""
        place, around, ends = 0, [], 0
        while place < len(self.tokens):
            kind, value, _ = self.tokens[place]
            if kind == "text":
                yield place, "word " + (around[-1] if around else ""), len(html.unescape(value).split())
            elif kind == "open":
                if self._aside(place, place < ends):
                    yield place, "aside", None
                    end = self.end.get(place)
                    if value in ("p", "li"):
                        following = next((k for k in range(place + 1, end or len(self.tokens)) if self.tokens[k][:2] == ("open", value)), None)
                        end = following - 1 if following is not None else end
                    if end is not None:
                        place = end
                else:
                    if value in _MARKS and place in self.end:
                        ends = max(ends, self.end[place])
                    if value not in _VOID:
                        around = [*around[-20:], value if value in _KNOWN else "other"]
                    yield place, "tag " + (value if value in _KNOWN else "other"), None
            else:
                if value in around:
                    del around[len(around) - 1 - around[::-1].index(value):]
                yield place, "tag " + (value if value in _KNOWN else "other"), None
            place += 1


def _counts(page: Page) -> dict[str, list[int]]:
    """[inside, outside] the marked article for each class of a self-labelled page; empty for others."""
    marks = page.marks()
    if len(marks) != 1 or marks[0] not in page.end:
        return {}
    low, high = marks[0], page.end[marks[0]]
    found: dict[str, list[int]] = {}
    for place, kind, words in page.pieces():
        if not (place in (low, high) or kind == "aside"):
            found.setdefault(kind, [0, 0])[not low < place < high] += 1 if words is None else words
    return found


def learn_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", sample: int = SAMPLE) -> dict[str, float]:
    """Weight of each class of words and tags; classes that no labelled page has are left to ``weight_of``."""
    import pyarrow as pa

    schema = pa.schema([("kind", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])

    def run(batches):
        total: dict[str, list[int]] = {}
        for (source,) in rows_of(batches):
            for kind, (a, b) in _counts(Page(source or "")).items():
                both = total.setdefault(kind, [0, 0])
                both[0] += a
                both[1] += b
        yield out_batch(schema, [list(total), [v[0] for v in total.values()], [v[1] for v in total.values()]])

    ids = pages.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample)
    chosen = pages.select(id_col, html_col).join(F.broadcast(ids), id_col).select(html_col)
    rows = chosen.mapInArrow(run, "kind string, inside long, outside long").groupBy("kind").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    found = {r["kind"]: (r["a"], r["b"]) for r in rows.collect()}  # at most two rows per element name in ``_KNOWN``
    inside, outside = sum(a for a, _ in found.values()) + 1, sum(b for _, b in found.values()) + 1
    odds = {kind: math.log((a + 0.5) / inside) - math.log((b + 0.5) / outside) for kind, (a, b) in found.items()}
    return {kind: min(max(v, LEAST_WORD), MOST_WORD) if kind.startswith("word") else min(max(v, LEAST_TAG), MOST_TAG) for kind, v in odds.items()}


def weight_of(kind: str, weights: dict[str, float]) -> float:
    if kind == "aside":
        return ASIDE_SCORE
    if kind in weights:
        return weights[kind]
    if kind.startswith("tag"):
        return FORBIDDING if kind[4:] in _MARKS else -0.1
    return 0.2 if kind == "word a" else 1.0


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Bounds [low, high) of the first stretch with the greatest sum; (0, 0) if no sum is positive."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """Text of the best stretch: references decoded, white space as one space, blocks joined by one space."""
    page = Page(source or "")
    pieces = list(page.pieces())
    low, high = best_stretch([(1 if words is None else words) * weight_of(kind, weights) for _, kind, words in pieces])
    if low == high:
        return ""
    first, last = pieces[low][0], pieces[high - 1][0]
    around = [(page.end.get(m, len(page.tokens)) - m, m) for m in page.marks() if m < first and last < page.end.get(m, len(page.tokens))]
    if around:
        size, mark = min(around)
        first, last = mark, mark + size
    out = []
    for place, kind, words in pieces:
        if first <= place <= last:
            if words is not None:
                out.append(html.unescape(page.tokens[place][1]))
            elif kind == "aside" or kind[4:] not in _INLINE:
                out.append(" ")
    return " ".join("".join(out).split())


def extracted(pages: DataFrame, html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """All columns of ``pages`` but ``html_col``, and text (empty if none, also for null html) and n_chars (long).

    Whole pages, however long; a page without a positive stretch has no text. Columns named text or n_chars are replaced.
    An empty table gives an empty result.
    """
    import pyarrow as pa

    weights = learn_weights(pages, html_col, id_col)

    def run(batches):
        for batch in batches:
            texts = []
            for at in range(0, batch.num_rows, 256):
                texts += [main_text(source, weights) for source in batch.column(batch.num_columns - 1).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    keep = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)
