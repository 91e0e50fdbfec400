"""Main text of web pages by markup and a host-wide suffix order.

A page is parsed into blocks.  Markup settles most of them: what lies in an article is content, what lies in
menus, headers, footers, adverts, forms and the like is not.  For the rest, the token streams of all other
blocks are put in suffix order per host, to a depth of ``RUN`` tokens: suffixes that agree that far are
neighbours, and where neighbours come from pages of different text, the tokens are boilerplate.  Covered
tokens are removed from unsettled blocks and the unique runs stay.

The suffix order is Spark's: suffixes are keyed by host and their first ``RUN`` tokens, partially aggregated before the
shuffle, so a host with most pages, or a menu on every page, is no single task's work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mintweave.llm import common as C
from mintweave.session import cut

RUN = 6
CONTENT, REST, BOILERPLATE = 0, 1, 2
PARTS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul"
BLOCKS = frozenset(PARTS.split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg canvas math select textarea button title datalist audio video".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|\s)(?:(?!(?:has|with|without|no|is|page|layout)[_-])[^\s]*[_-])?(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|sidebar|side-bar|menu\w*|nav\w*|breadcrumbs?|footer|header|masthead|comments?|comment-\w+|"
    r"disqus|respond|replies|share|sharing|social|newsletter|subscribe|subscription|related|recommended|popup|modal|overlay|widget|toolbar|pagination|pager|login|signup)(?:$|\s)"
    r"|(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|sidebar|side-bar|menu\w*|nav\w*|breadcrumbs?|footer|header|masthead|comments?|disqus|respond|replies|share|sharing|social|newsletter|"
    r"subscribe|subscription|related|recommended|popup|modal|overlay|widget|toolbar|pagination|pager|login|signup)[_-]",
    re.IGNORECASE,
)
#: A tag that closes an open element of these kinds, as browsers do.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Blocks(HTMLParser):
    """Blocks of a page in order: role and text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, role around them, whether silent, whether named a header.
        self.open: list[tuple[str, int | None, bool, bool]] = []
        self.role, self.mute = REST, 0
        self.found: list[tuple[int, str]] = []
        self.pieces: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.found.append((self.role, text))
        self.pieces = []

    def _role_of(self, tag: str, attributes: dict[str, str | None]) -> int | None:
        if tag in HEADINGS and any(t in ("article", "main") for t, *_ in self.open) and (self.open[-1][0] == "header" or self.open[-1][3]):
            return CONTENT  # the article's own title
        named = " ".join(filter(None, (attributes.get("class"), attributes.get("id"))))
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in (attributes.get("style") or "").replace(" ", "").lower()
        if tag in ASIDE or (attributes.get("role") or "").lower() in ROLES or hidden or (tag not in ("html", "body", "article", "main") and NAMES.search(named)):
            return BOILERPLATE
        # Nothing but the page itself stands around a main element or form-wide article.
        inside = any(t in ("article", "main") or t in ASIDE - {"form"} for t, *_ in self.open)
        if (self.role != BOILERPLATE or not inside and (tag == "main" or tag == "article" and any(t == "form" for t, *_ in self.open))) and (tag in ("article", "main") or (attributes.get("role") or "").lower() in ("main", "article")):
            return CONTENT
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self.pieces.append(" ")
            return
        closes = CLOSES.get(tag)
        if closes and self.open and self.open[-1][0] in closes:
            self.handle_endtag(self.open[-1][0])
        elif tag in BLOCKS:
            self._leave_paragraph()
        named = dict(attrs)
        role = self._role_of(tag, named)
        if tag in BLOCKS or role is not None:
            self._flush()
        self.open.append((tag, self.role, tag in SILENT, bool(re.search(r"(?:^|[\s_-])header(?:$|\s)", named.get("class") or ""))))
        self.mute += tag in SILENT
        self.role = self.role if role is None else role

    def _leave_paragraph(self) -> None:
        """A block tag ends an open paragraph, with the inline elements left open in it."""
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == "p":
                self.handle_endtag("p")
                return
            if name in BLOCKS:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not any(name == tag for name, *_ in self.open):
            return
        while self.open:
            name, role, silent, _ = self.open.pop()
            if name in BLOCKS or role != self.role:
                self._flush()
            self.role = role
            self.mute -= silent
            if name == tag:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...>`` of any kind is a comment in pages; it ends at the next ``>``."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_data(self, data: str) -> None:
        if not self.mute:
            self.pieces.append(data)


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """Role and text of every block; none for null or empty markup, and where the parser gives up those before that place."""
    if not html:
        return []
    parser = Blocks()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # markup that the parser gives up on; what it has read stays
        pass
    parser._flush()
    return parser.found


def parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``id, url, host, roles, texts`` per page."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [blocks_of(h.as_py()) for h in part.column(2)]
            hosts = [re.sub(r"^[^/]*//", "", u or "").split("/")[0].split("?")[0].split("#")[0].rsplit("@")[-1].lower() for u in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(hosts), pa.array([[r for r, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[t for _, t in f] for f in found], pa.list_(pa.string()))],
                names=["id", "url", "host", "roles", "texts"],
            )

    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return C.per_batch(rows, work, "id long, url string, host string, roles array<int>, texts array<string>")


def suffixes(blocks: DataFrame) -> DataFrame:
    """``host, run, id, spot, body``: every suffix outside the articles, by its first ``RUN`` tokens; ``body`` marks the page's whole text."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            whole = "\n".join(row["texts"]).encode()
            stream = " ".join(t for r, t in zip(row["roles"], row["texts"]) if r != CONTENT).encode()
            with np.errstate(over="ignore"):
                ends = []
                for text in (stream, whole):
                    data = np.frombuffer(text, np.uint8)
                    starts, stops, _ = C.word_spans(data, np.array([0, len(data)]))
                    ends.append(C.word_hashes(data, starts, stops))
                runs = C.run_hashes(ends[0], RUN)
                body = C.mix(np.append(ends[1], np.uint64(1)) * np.arange(1, len(ends[1]) + 2, dtype=np.uint64)).sum(dtype=np.uint64)
            if len(runs):
                n = len(runs)
                yield pa.RecordBatch.from_arrays([pa.array([row["host"]] * n), pa.array(runs.view(np.int64)), pa.array(np.full(n, row["id"] if row["id"] is not None else -1)), pa.array(np.arange(n)), pa.array(np.full(n, body).view(np.int64))], names=["host", "run", "id", "spot", "body"])

    return C.per_batch(blocks.select("id", "host", "roles", "texts"), work, "host string, run long, id long, spot long, body long")


def kept_text(roles: list[int], texts: list[str], covered: set[int]) -> str:
    """Content blocks, and of unsettled ones the tokens that no repeated run covers."""
    out, at = [], 0
    for role, text in zip(roles, texts):
        if role == CONTENT:
            out.append(text)
            continue
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        if role == REST:
            own = [w for k, w in enumerate(words, at) if not any(k - d in covered for d in range(RUN))] if covered else words
            if own:
                out.append(" ".join(own) if len(own) < len(words) else text)
        at += len(words)
    return "\n".join(out)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` of every page.

    A null, empty or text-less page has the empty text.  A page whose markup names an article keeps only blocks in it;
    unsettled blocks matter on pages without one.  Pages with equal text do not count as distinct, so a copied
    page keeps its text.  Rows are kept one for one; a null url is a host of its own; other columns are not read.
    """
    blocks = cut(parsed(pages, key, url, html), "blocks")
    lone = ~F.array_contains("roles", CONTENT) & F.array_contains("roles", REST)
    # every page tells what repeats on its host; only pages without an article have anything to decide
    rows = suffixes(blocks)
    repeated = rows.groupBy("host", "run").agg(F.min("body").alias("x"), F.max("body").alias("y")).filter("x <> y").select("host", "run")
    unsettled = blocks.filter(lone)
    spots = suffixes(unsettled).join(repeated, ["host", "run"], "left_semi").groupBy("id").agg(F.collect_set("spot").alias("covered"))

    @F.pandas_udf("string")
    def chosen(roles: pd.Series, texts: pd.Series, covered: pd.Series) -> pd.Series:
        out = []
        for r, t, c in zip(roles, texts, covered):
            settled = CONTENT in r
            out.append(kept_text([BOILERPLATE if settled and x == REST else x for x in r], t, set() if c is None else set(c)))
        return pd.Series(out)

    done = blocks.filter(~lone).withColumn("covered", F.lit(None).cast("array<bigint>"))
    both = done.unionByName(unsettled.join(spots, "id", "left"))
    return both.withColumn("text", chosen("roles", "texts", "covered")).select("id", "url", "text", F.length("text").cast("long").alias("n_chars"))
