"""Documents as rows of blocks: html elements in their order, JSON payloads, links, metadata, sitemaps.

Only the walk over the tags of a page runs in Python, in Arrow batches and one page at a time; numbering, section paths,
hashes and languages follow from its rows by built-in functions.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, url
from .json_walk import leaves_of

#: Elements that make blocks, with the kind of block (fixed values).
ELEMENTS = {"title": "title", "p": "paragraph", "li": "list", "table": "table", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading"}
#: Elements whose own text is not shown (fixed values).
HIDDEN = ("script", "style", "noscript")
#: Versions of the ways to read documents, as blocks name them (fixed values).
HTML_VERSION, STRUCTURED_VERSION = "html-1.0", "structured-1.0"


class _Walk(HTMLParser):
    """The elements, metadata, links and JSON scripts of one page, as tags close.

    A closing tag ends the innermost open element of its name and drops those opened inside it unclosed; a nested
    element's text counts for the outer ones too. Texts stand in one list, and an open element is the place at which it
    starts there, so tags that never close, as those of breaks and images, cost a number each.
    """

    def __init__(self):
        super().__init__()
        self.texts: list[str] = []
        self.open: list[tuple[str, dict[str, str], int]] = []  # tag, attributes, start among the texts
        self.places: dict[str, list[int]] = {}  # of the open elements by tag
        self.elements: list[tuple[str, str]] = []
        self.links: list[tuple[str, str]] = []
        self.meta: list[tuple[str, str]] = []
        self.scripts: list[tuple[str, str]] = []  # type, text
        self.plain: list[str] = []
        self.language = ""

    def handle_starttag(self, tag, attrs):
        own = {k: v or "" for k, v in attrs}
        said = lambda *names: next((own[n].strip() for n in names if own.get(n, "").strip()), "")
        if tag == "html":
            self.language = said("lang").lower().replace("_", "-")[:16] or self.language
        if tag == "meta" and said("name", "property", "http-equiv") and said("content"):
            self.meta.append((said("name", "property", "http-equiv"), said("content")))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, own, len(self.texts)))

    def handle_data(self, data):
        if not self.places.get("script"):
            self.plain.append(data)
        self.texts.append(data)

    def handle_endtag(self, tag):
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        _, own, start = self.open[at]
        for name, *_ in self.open[at:]:
            self.places[name].pop()
        del self.open[at:]
        if tag in ELEMENTS:
            self.elements.append((tag, " ".join(self.texts[start:])))
        elif tag == "script":
            self.scripts.append((own.get("type", "").strip().lower(), "".join(self.texts[start:])))
        elif tag == "a" and own.get("href", "").strip():
            self.links.append((own["href"].strip(), " ".join("".join(self.texts[start:]).split())))


FRAMES = "what string, name string, content string, extra string, ord int"


def html_frames(pages: DataFrame, id_: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, what, name, content, extra, ord of all that a page (id, html) is made of, in the order in which blocks are built, and the columns to keep.

    what is json_ld (content: the payload with its keys in order, extra: its number, name: its field paths as JSON), meta
    (name, content, extra: its number), element (name: the tag, content), link (content: its text, extra: href), plain (the
    visible text), markup (the whole html, of pages that show no text) or language. White space is collapsed. A null html gives no rows; a page that can't be read to its end gives what was read.
    """
    own = (id_, *keep)
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in own)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 32):
                part = b.slice(at, 32)
                whose, rows = [], []
                for k, html in enumerate(part.column(len(own)).to_pylist()):
                    found = frames_of(html)
                    whose += [k] * len(found)
                    rows += found
                index = pa.array(whose, pa.int64())
                columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(index) for i in range(len(own))), *columns, pa.array([r[4] for r in rows], pa.int32())], [*own, "what", "name", "content", "extra", "ord"])

    return pages.select(*own, "html").mapInArrow(run, f"{kinds}, {FRAMES}")


def frames_of(html: str | None) -> list[tuple[str, str | None, str, str | None, int]]:
    if not html:
        return []
    walk, out = _Walk(), []
    try:
        walk.feed(html)
        walk.close()
    except (AssertionError, ValueError):
        pass  # what was read until then stands

    def add(what, name, content, extra=None):
        content = " ".join(content.split())
        if content:
            out.append((what, name, content, extra, len(out)))

    payloads = [raw for kind, raw in walk.scripts if kind == "application/ld+json" and raw.strip()]
    for n, raw in enumerate(payloads, 1):
        try:
            payload = json.dumps(json.loads(raw), ensure_ascii=False, sort_keys=True)
        except (ValueError, RecursionError):
            continue
        add("json_ld", json.dumps([path for path, _, _ in leaves_of(payload)], ensure_ascii=False), payload, str(n))
    for n, (name, content) in enumerate(walk.meta, 1):
        add("meta", name, content, str(n))
    for name, content in walk.elements:
        add("element", name, content)
    for href, label in walk.links:
        out.append(("link", None, label, href, len(out)))
    plain = " ".join(walk.plain)
    add("plain" if plain.strip() else "markup", None, plain if plain.strip() else html)
    add("language", None, walk.language)
    return out


def number_blocks(frames: DataFrame, id_: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, block_key, block_type, what, name, content, extra, number (of its tag), ord, section_path and the columns to keep of the blocks that frames make.

    Keys count within their prefix. A heading of level L keeps L - 1 of the headings before it, fewer if there are fewer:
    of the i-th heading the stack is i + min(0, least level_j - j for j up to i) long, which is its place in the path, and
    the path at a block holds the last heading of each place up to the length of the last heading's stack.
    """
    level = F.when((F.col("what") == "element") & F.col("name").rlike("^h[1-6]$"), F.substring("name", 2, 1).cast("int"))
    to_here = Window.partitionBy(id_).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = frames.withColumn("__level", level).withColumn("__i", F.count("__level").over(to_here))
    rows = rows.withColumn("__least", F.min(F.col("__level") - F.when(F.col("__level").isNotNull(), F.col("__i"))).over(to_here))
    rows = rows.withColumn("__depth", F.col("__i") + F.least(F.lit(0), F.coalesce("__least", F.lit(0))))
    places = []
    for n in range(1, 7):
        here = F.when(F.col("__level").isNotNull() & (F.col("__depth") == n), F.col("content"))
        places.append(F.when(F.col("__depth") >= n, F.last(here, ignorenulls=True).over(to_here)))
    path = F.when(F.col("what") == "element", F.array_compact(F.array(*places))).otherwise(F.array().cast("array<string>"))
    path = F.when(F.col("name") == "title", F.array().cast("array<string>")).otherwise(path)
    prefix = (
        F.when(F.col("what") == "json_ld", F.concat(F.lit("json_ld_"), F.lpad("extra", 4, "0"))).when(F.col("what") == "meta", "meta").when(F.col("what") == "link", "link")
        .when(F.col("name") == "p", "paragraph").when(F.col("name") == "li", "list").otherwise(F.col("name"))
    )
    kinds = F.create_map(*[F.lit(x) for kv in ELEMENTS.items() for x in kv])
    kind = F.when(F.col("what") == "json_ld", "table").when(F.col("what") == "meta", "metadata").when(F.col("what") == "link", "link").otherwise(kinds[F.col("name")])
    content = F.when(F.col("what") == "meta", F.concat_ws(": ", "name", "content")).otherwise(F.col("content"))
    rows = rows.withColumn("section_path", path).where(F.col("what").isin("json_ld", "meta", "element", "link")).withColumn("__prefix", prefix)
    number = F.row_number().over(Window.partitionBy(id_, "__prefix").orderBy("ord"))
    key = F.concat(F.col("__prefix"), F.lit("_"), F.lpad(number.cast("string"), 4, "0"))
    return rows.select(id_, key.alias("block_key"), kind.alias("block_type"), "what", "name", content.alias("content"), F.col("content").alias("bare"), "extra", number.alias("number"), "ord", "section_path", *keep)


def html_blocks(pages: DataFrame, id_: str = "page_id", language: str | None = None) -> DataFrame:
    """id, block_key, block_type, text_content, block_hash, language, section_path, href, location, metadata, ord of the blocks of pages (id, url, html).

    Links are resolved against the page's url and shown by it where they have no text. A page without a title, heading,
    paragraph, list or table has its visible text as one paragraph. The language is the source's tag, from the column
    that language names, else the page's, else follows from its visible text, or from its html if it shows none. location
    (where in the page) and metadata (what the block's kind adds) are JSON.
    """
    # pages are walked once; what is said of a whole page comes by windows over its own rows
    page, keep = Window.partitionBy(id_), ("url",) if language is None else ("url", language)
    of = lambda what: F.max(F.when(F.col("what").isin(*what), F.col("content"))).over(page)
    frames = html_frames(pages, id_, keep).withColumns({"__plain": of(("plain", "markup")), "__tag": of(("language",)), "__has": F.max(F.col("what").isin("element", "json_ld")).over(page)})
    lone = (F.col("what") == "plain") & ~F.col("__has")
    frames = frames.withColumns({"__lone": lone, "name": F.when(lone, "p").otherwise(F.col("name")), "what": F.when(lone, "element").otherwise(F.col("what"))})
    blocks = number_blocks(frames, id_, (*keep, "__plain", "__tag", "__lone"))
    link = F.col("block_type") == "link"
    blocks = blocks.withColumn("href", F.when(link, url.resolve(F.col("extra"), F.coalesce("url", F.lit("")))))
    blocks = blocks.withColumn("text_content", F.when(link & (F.col("content") == ""), F.col("href")).otherwise(F.col("content")))
    given = F.col("__tag") if language is None else F.coalesce(F.nullif(F.col(language), F.lit("")), "__tag")
    known = text.infer_language(F.coalesce("__plain", F.lit("")), tag=given)
    what, name, number = F.col("what"), F.col("name"), F.col("number").cast("int")
    at = lambda *fields: F.to_json(F.struct(*fields))
    nth = lambda alias, n=number: n.cast("int").alias(alias)
    location = (
        F.when(what == "json_ld", at(F.lit("json-ld").alias("kind"), nth("script_ordinal", F.col("extra")))).when(what == "meta", at(F.lit("meta").alias("kind"), nth("ordinal", F.col("extra"))))
        .when(link, at(F.lit("a").alias("tag"), nth("ordinal"))).when(F.col("__lone"), at(F.lit("plain-text-fallback").alias("kind"), nth("ordinal", F.lit(1)))).otherwise(at(name.alias("tag"), nth("ordinal")))
    )
    source = F.coalesce("url", F.lit("")).alias("source_url")
    provenance = F.struct(source, F.concat(F.lit("script[type=application/ld+json]["), "extra", F.lit("]")).alias("evidence_location")).alias("provenance")
    metadata = (
        F.when(what == "json_ld", at(F.lit("json-ld").alias("format"), F.from_json("name", "array<string>").alias("field_paths"), provenance))
        .when(what == "meta", at(F.when(F.lower("name").startswith("og:"), "opengraph").otherwise("meta").alias("kind"), name.alias("name"), F.col("bare").alias("content")))
        .when(link, at(F.col("href").alias("href"), F.col("content").alias("label"), source)).when(F.col("block_type") == "title", at(F.lit("document_title").alias("kind")))
        .when(F.col("block_type") == "heading", at(F.substring("name", 2, 1).cast("int").alias("level"))).otherwise(F.lit("{}"))
    )
    return blocks.select(
        id_, "block_key", "block_type", "text_content", F.sha2("text_content", 256).alias("block_hash"), known.alias("language"), "section_path", "href", location.alias("location"), metadata.alias("metadata"), "ord"
    )


def json_blocks(snapshots: DataFrame, id_: str = "snapshot_id", content: str = "content") -> DataFrame:
    """id, block_key, block_type, text_content (keys in order), block_hash of each JSON payload; what can't be read gives none."""
    whole = F.to_json(F.try_parse_json(content))
    rows = snapshots.select(id_, whole.alias("text_content")).where("text_content IS NOT NULL")
    return rows.select(id_, F.lit("structured_0001").alias("block_key"), F.lit("structured").alias("block_type"), "text_content", F.sha2("text_content", 256).alias("block_hash"))


def json_ld(pages: DataFrame, id_: str = "page_id") -> DataFrame:
    """id, script (its number among the page's JSON scripts), payload (keys in order) of scripts that hold JSON."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    rows = pages.select(id_, F.posexplode(F.filter(scripts, lambda x: F.trim(x) != "")).alias("at", "raw"))
    return rows.select(id_, (F.col("at") + 1).alias("script"), F.to_json(F.try_parse_json("raw")).alias("payload")).where("payload IS NOT NULL")


def page_meta(pages: DataFrame, id_: str = "page_id") -> DataFrame:
    """id, name, content of every meta element with a name or property and a content, in their order (ord)."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<meta\s[^>]*>"), 0)
    rows = pages.select(id_, F.posexplode(tags).alias("ord", "tag"))
    said = lambda name: F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    name = F.coalesce(*[F.nullif(F.trim(said(n)), F.lit("")) for n in ("name", "property", "http-equiv")])
    return rows.select(id_, "ord", name.alias("name"), F.trim(said("content")).alias("content")).where("name IS NOT NULL AND content <> ''")


def page_links(pages: DataFrame, id_: str = "page_id") -> DataFrame:
    """id, pos, href, resolved (empty for other schemes than http and https), label of every anchor, in their order."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a\s*>"), 0)
    rows = pages.select(id_, "url", F.posexplode(anchors).alias("pos", "anchor"))
    href = F.trim(F.regexp_extract("anchor", r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1))
    label = text.clean_text(F.regexp_replace("anchor", "<[^>]*>", ""))
    rows = rows.select(id_, "url", "pos", href.alias("href"), label.alias("label"))
    return rows.select(id_, "pos", "href", url.canonical_url(url.resolve(F.col("href"), F.col("url"))).alias("resolved"), "label")


def canonical_links(pages: DataFrame, id_: str = "page_id") -> DataFrame:
    """id, canonical: the resolved href of each page's link elements that name a canonical url."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<link\s[^>]*>"), 0)
    rows = pages.select(id_, "url", F.explode(tags).alias("tag")).where(F.col("tag").rlike(r"(?is)\srel\s*=\s*[\"'][^\"']*canonical"))
    href = F.trim(F.regexp_extract("tag", r"(?is)\shref\s*=\s*[\"']([^\"']*)[\"']", 1))
    return rows.select(id_, "url", href.alias("href")).where("href <> ''").select(id_, url.canonical_url(url.resolve(F.col("href"), F.col("url"))).alias("canonical"))


def sitemap_urls(sitemaps: DataFrame, limit: int = 100) -> DataFrame:
    """sitemap_url, pos, location, is_index of the first limit loc values of each sitemap that stay on its domain.

    is_index tells locations that lead to further sitemaps: those of an index, and those that end in .xml or .xml.gz.
    """
    raw = F.slice(F.regexp_extract_all("content", F.lit(r"(?is)<loc\b[^>]*>(.*?)</loc\s*>"), 1), 1, limit)
    rows = sitemaps.select("sitemap_url", F.contains(F.lower("content"), F.lit("<sitemapindex")).alias("__index"), F.posexplode(raw).alias("pos", "value"))
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        rows = rows.withColumn("value", F.replace("value", F.lit(entity), F.lit(letter)))
    rows = rows.select("sitemap_url", "pos", "__index", url.canonical_url(url.resolve(F.trim("value"), F.col("sitemap_url"))).alias("location"))
    rows = rows.where((F.col("location") != "") & (url.normalize_domain(F.col("location")) == url.normalize_domain(F.col("sitemap_url"))))
    return rows.select("sitemap_url", "pos", "location", (F.col("__index") | F.lower("location").rlike(r"\.xml(\.gz)?$")).alias("is_index"))


def parse_summary(snapshots: DataFrame, blocks: DataFrame, id_: str = "snapshot_id", version: str = HTML_VERSION) -> DataFrame:
    """id, parser_version, language (of the first block, else of the snapshot), parser_status, n_blocks of every snapshot."""
    own = blocks.groupBy(id_).agg(F.count("*").alias("n_blocks"), F.min_by("language", "block_key").alias("__language"))
    out = snapshots.join(own, id_, "left")
    status = F.when(F.col("content").isNull(), "failed").otherwise("success")
    return out.select(id_, F.lit(version).alias("parser_version"), F.coalesce("__language", "language").alias("language"), status.alias("parser_status"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
