"""Job settings. They live on the driver and enter plans only as literals."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

# Default selector lists, result-relevant, in priority order.
DEFAULT_CONTENT_SELECTORS = "main, article, .entry-content, .site-main, #content, body"
BUILT_IN_EXCLUSIONS = (
    "nav",
    "header",
    "footer",
    "aside",
    ".site-header",
    ".site-footer",
    ".cookie",
    ".cookies",
    ".sr-only",
    '[aria-hidden="true"]',
    "script",
    "style",
    "noscript",
    "iframe",
)
MIN_CONTENT_BYTES = 50
MIN_TTL_SECONDS = 60
DAY_SECONDS = 86_400


@dataclass(frozen=True)
class Settings:
    """The 22 settings a job can be run with."""

    enabled: bool = True
    accept_header_enabled: bool = True
    md_urls_enabled: bool = True
    query_param_enabled: bool = True
    link_headers_enabled: bool = True
    head_alternate_link: bool = True
    caching_enabled: bool = True
    cache_ttl: int = DAY_SECONDS
    post_types: tuple[str, ...] = ("post", "page")
    content_selectors: str = DEFAULT_CONTENT_SELECTORS
    excluded_selectors: str = ""
    include_h1: bool = True
    include_canonical: bool = True
    include_excerpt: bool = True
    include_featured_image: bool = False
    featured_image_position: str = "append"
    disable_logged_in: bool = True
    disable_noindex: bool = True
    allow_404: bool = False
    allow_search: bool = False
    allow_archives: bool = False
    debug_enabled: bool = False

    def with_(self, **changes: Any) -> Settings:
        return replace(self, **changes)

    @property
    def ttl_seconds(self) -> int:
        return max(MIN_TTL_SECONDS, int(self.cache_ttl))


@dataclass(frozen=True)
class Site:
    """Site-wide options which are not settings of the job."""

    home: str = "https://example.com"
    show_on_front: str = "page"
    page_on_front: int = 0
    posts_page_url: str | None = None
    version: str = "1.0.0"
    language_column: str | None = None  # page column with the language, where the caller knows it; else the page's own
    path_variable: str = "md_path"  # the query variable in which the site's own rewrite rule hands on the path


def _truthy(value: Any) -> bool:
    # null, false, 0, '', '0' and empty lists count as "off"
    return bool(value) and value != "0"


def _plain_text(value: Any) -> str:
    import re

    return re.sub(r"<[^>]*>", "", str(value)).strip(" \t\n\r\0\x0b")


def sanitize_settings(raw: Mapping[str, Any] | None, viewable_types: Iterable[str]) -> Settings:
    """Turn loosely typed input into valid settings.

    Missing switches are off, as an unticked box is not submitted; types outside the viewable set
    are dropped, and an empty list falls back to the defaults.
    """
    raw = raw if isinstance(raw, Mapping) else {}
    base = Settings()
    out: dict[str, Any] = {
        f.name: _truthy(raw.get(f.name)) for f in fields(Settings) if isinstance(f.default, bool)
    }
    try:
        ttl = abs(int(raw.get("cache_ttl", base.cache_ttl)))
    except (TypeError, ValueError):
        ttl = 0
    out["cache_ttl"] = max(MIN_TTL_SECONDS, ttl)

    types = raw.get("post_types", ())
    if isinstance(types, str):
        types = types.split(",")
    viewable = set(viewable_types)
    cleaned = ("".join(c for c in str(t).strip().lower() if c.isascii() and (c.isalnum() or c in "_-")) for t in types)
    out["post_types"] = tuple(dict.fromkeys(t for t in cleaned if t in viewable)) or base.post_types

    out["content_selectors"] = _plain_text(raw.get("content_selectors", base.content_selectors))
    out["excluded_selectors"] = _plain_text(raw.get("excluded_selectors", base.excluded_selectors))
    position = raw.get("featured_image_position")
    out["featured_image_position"] = position if position in ("prepend", "append") else "append"
    return Settings(**out)


def split_list(text: str) -> list[str]:
    """Comma list -> trimmed entries; empty entries and '0' are dropped, order is kept."""
    parts = (p.strip(" \t\n\r\0\x0b") for p in text.split(","))
    return [p for p in parts if p not in ("", "0")]


def content_selector_list(cfg: Settings) -> list[str]:
    text = cfg.content_selectors if cfg.content_selectors.strip(" \t\n\r\0\x0b") else DEFAULT_CONTENT_SELECTORS
    return split_list(text)


def excluded_selector_list(cfg: Settings) -> list[str]:
    """Built-in exclusions plus the configured ones, without duplicates."""
    return list(dict.fromkeys([*BUILT_IN_EXCLUSIONS, *split_list(cfg.excluded_selectors)]))
