"""Title, description, lead image and the front matter above the body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import markup as M
from ..functions import text as T

EXCERPT_WORDS = 55


def page_title(html: Column) -> Column:
    """Text of the title element, decoded and trimmed, '' when missing (M13). Comments, scripts and inline graphics
    that stand before it may hold another; where there are any they are taken out first."""
    element = r"(?is)<title(?=[\s/>])[^>]*>(.*?)</title(?=[\s/>])[^>]*>"
    return T.trim(T.decode_entities(F.regexp_extract(_without_decoys(html, "title"), element, 1)))


def _without_decoys(html: Column, name: str) -> Column:
    """html without comments, scripts and inline graphics, where any stand before the first tag of this name."""
    head = F.get(F.split(html, rf"(?i)<{name}(?=[\s/>])", 2), F.lit(0))
    bare = F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|{M.RAW_RE}|<svg(?=[\s/>]).*?(?:</svg(?=[\s/>])[^>]*>|\z)", "")
    return F.when(head.rlike(r"(?i)<(?:!--|script|style|noscript|iframe|svg)"), bare).otherwise(html)


def page_language(html: Column) -> Column:
    """The whole code of the html tag's lang attribute, in lower case, '' when there is none. An html tag in a comment
    or script before it does not count."""
    lang = F.regexp_extract(_without_decoys(html, "html"), r"""(?is)<html\b[^>]*\blang\s*=\s*["']?\s*([A-Za-z][A-Za-z0-9_-]*)""", 1)
    return F.lower(lang)


def excerpt(own: Column, content: Column) -> Column:
    """The explicit excerpt if there is one, else the first 55 words of the content without tags."""
    words = T.first_words(T.strip_markup(F.coalesce(content, F.lit(""))), EXCERPT_WORDS)
    return T.trim(T.strip_tags(F.when(T.not_blank(own), own).otherwise(words)))


def meta_description(seo: Column, meta: Column) -> Column:
    """SEO description when it is not blank, else the metadata value, else '' (M15)."""
    return F.when(T.not_blank(seo), T.trim(seo)).otherwise(T.trim(F.coalesce(meta, F.lit(""))))


def descriptions(posts: DataFrame, meta_wide: DataFrame) -> DataFrame:
    """page_id, description: the metadata description, else the excerpt (M14 behind M15)."""
    seo = F.col("seo_description") if "seo_description" in posts.columns else F.lit(None).cast("string")
    own = F.col("excerpt") if "excerpt" in posts.columns else F.lit(None).cast("string")
    # the excerpt is made before the join, so that no page text moves
    short = posts.select("post_id", seo.alias("seo"), excerpt(own, F.col("post_content")).alias("excerpt"))
    about = short.join(meta_wide.select("post_id", "description"), "post_id", "left")
    meta = meta_description(F.col("seo"), F.col("description"))
    return about.select(F.col("post_id").alias("page_id"), F.when(meta != "", meta).otherwise(F.col("excerpt")).alias("description"))


def safe_url(c: Column) -> Column:
    """Only characters that may stand in a URL stay."""
    return F.regexp_replace(c, r"""[^A-Za-z0-9$\-_.+!*'(),{}|\\^~\[\]`<>#%";/?:@&=]""", "")


def lead_image(content: Column) -> Column:
    """First image with a target in the extracted HTML, as Markdown, '' when there is none."""
    tag_re = r"""(?i)<img[^>]+src=["']([^"']+)["'][^>]*>"""
    src = safe_url(F.regexp_extract(content, tag_re, 1))
    alt = T.trim(F.regexp_extract(F.regexp_extract(content, tag_re, 0), r"""(?i)alt=["']([^"']*)["']""", 1))
    return F.when(src == "", "").otherwise(F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")")))


def front_matter(body: Column, title: Column, canonical: Column, description: Column, image: Column, cfg: Settings) -> Column:
    """Title, source, description and image lines above the body, joined by blank lines."""
    empty = F.lit("")

    def line(on: bool, value: Column, mark: str = "") -> Column:
        return F.when(F.coalesce(value, empty) != "", F.concat(F.lit(mark), value)).otherwise("") if on else empty

    parts = [
        line(cfg.include_h1, title, "# "),
        line(cfg.include_canonical, canonical, "Source: "),
        line(cfg.include_excerpt, T.decode_entities(F.coalesce(description, empty))),
    ]
    picture = line(cfg.include_featured_image, image)
    parts = [picture, *parts] if cfg.featured_image_position == "prepend" else [*parts, picture]
    head = F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")
    return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n\n"), body))
