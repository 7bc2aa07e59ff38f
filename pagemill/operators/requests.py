"""Request classification and eligibility (R1-R16, R19): projections over one table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings, Site
from ..functions import text as T
from ..functions.urls import query_value, request_path

# Statuses that are never given out.
CLOSED_STATUSES = ("private", "draft", "pending", "future")
LOGIN_SCRIPTS = ("wp-login.php", "wp-register.php")
VIEW_FLAGS = (
    "admin", "rest", "ajax", "xmlrpc", "feed", "cron", "preview", "404", "search", "archive", "singular",
    "front_page", "home",
)


def flag(view: str) -> Column:
    return F.col(f"is_{view}")


def with_view_flags(requests: DataFrame) -> DataFrame:
    """One boolean per view. A table may bring flags of its own or a single view column."""
    view = F.col("view") if "view" in requests.columns else F.lit(None).cast("string")
    return requests.withColumns(
        {
            f"is_{v}": F.coalesce(F.col(f"is_{v}") if f"is_{v}" in requests.columns else view == v, F.lit(False))
            for v in VIEW_FLAGS
        }
    )


def accepts_markdown(cfg: Settings) -> Column:
    """text/markdown anywhere in the header; quality values are not looked at (R2)."""
    return F.contains(F.lower("accept"), F.lit("text/markdown")) & F.lit(cfg.accept_header_enabled)


def markdown_path(cfg: Settings) -> Column:
    return F.col("path").rlike(r"(?i)\.md/?$") & F.lit(cfg.md_urls_enabled)


def markdown_query(cfg: Settings) -> Column:
    """format or output equals markdown."""
    wanted = [F.lower(query_value(F.col("uri"), n)) == "markdown" for n in ("format", "output")]
    return (wanted[0] | wanted[1]) & F.lit(cfg.query_param_enabled)


def rewrite_path(cfg: Settings, site: Site = Site()) -> Column:
    """The path a '.md' address stands for: '' for the front page, null when no rule applies.
    Unlike R3 the rules are case-sensitive."""
    path = F.ltrim(F.col("path"), F.lit("/"))
    by_rule = F.when(path.rlike(r"^\.md/?$"), "").when(path.rlike(r"\.md/?$"), F.regexp_extract(path, r"^(.+?)\.md/?$", 1))
    given = query_value(F.col("uri"), site.path_variable)
    return F.when(given != "", given).when(F.lit(cfg.md_urls_enabled), by_rule)


def classify_requests(requests: DataFrame, cfg: Settings, site: Site = Site()) -> DataFrame:
    """Adds path, the four ways to ask for Markdown, md_method and is_explicit."""
    known = with_view_flags(requests).withColumn("path", request_path(F.col("uri")))
    asked = known.withColumns(
        {
            "wants_accept": accepts_markdown(cfg),
            "wants_url": markdown_path(cfg),
            "wants_query": markdown_query(cfg),
            "md_path": rewrite_path(cfg, site),
        }
    )
    routed = F.coalesce(T.clean_value(F.col("md_path")) != "", F.lit(False))
    return asked.withColumns(
        {
            "md_method": F.when(F.col("wants_accept") & F.lit(cfg.enabled), "accept")
            .when(F.col("wants_url"), "url")
            .when(F.col("wants_query"), "query")
            .when(routed, "rewrite"),
            "is_explicit": F.col("wants_url") | F.col("wants_query") | routed,
        }
    )


def is_sitemap() -> Column:
    path = F.lower("path")
    return F.contains(path, F.lit("sitemap")) & path.endswith(".xml")


def is_robots() -> Column:
    return F.ltrim(F.lower("path"), F.lit("/")) == "robots.txt"


def is_auth(page_name: Column | None = None) -> Column:
    """A login script in the path, or as the page's own name where the log has it (column page_name)."""
    path = F.lower("path")
    in_path = F.contains(path, F.lit(LOGIN_SCRIPTS[0])) | F.contains(path, F.lit(LOGIN_SCRIPTS[1]))
    return in_path if page_name is None else in_path | F.coalesce(page_name.isin(*LOGIN_SCRIPTS), F.lit(False))


def type_allowed(cfg: Settings) -> Column:
    """Listed in the settings and publicly viewable."""
    return F.col("post_type").isin(*cfg.post_types) & F.coalesce(F.col("viewable"), F.lit(False))


def _first_reason(rules: list[tuple[str, Column]]) -> Column:
    out = None
    for name, test in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def hard_reason(cfg: Settings, page_name: Column | None = None) -> Column:
    """The first rule that rules a request out, null if none does."""
    has_post = F.col("post_status").isNotNull()
    return _first_reason(
        [
            ("admin", flag("admin")),
            ("rest", flag("rest")),
            ("ajax", flag("ajax")),
            ("xmlrpc", flag("xmlrpc")),
            ("feed", flag("feed")),
            ("sitemap", is_sitemap()),
            ("robots", is_robots()),
            ("cron", flag("cron")),
            ("auth", is_auth(page_name)),
            ("preview", flag("preview")),
            ("404", flag("404") & F.lit(not cfg.allow_404)),
            ("search", flag("search") & F.lit(not cfg.allow_search)),
            ("archive", flag("archive") & F.lit(not cfg.allow_archives)),
            ("password", F.coalesce(F.col("password_required"), F.lit(False))),
            ("status", has_post & F.col("post_status").isin(*CLOSED_STATUSES)),
            ("post_type", has_post & ~F.coalesce(type_allowed(cfg), F.lit(False))),
        ]
    )


def supported_view(cfg: Settings) -> Column:
    """A single page, the front page or the posts page, or an allowed 404, search or archive."""
    return (
        flag("singular")
        | flag("front_page")
        | flag("home")
        | (flag("404") & F.lit(cfg.allow_404))
        | (flag("search") & F.lit(cfg.allow_search))
        | (flag("archive") & F.lit(cfg.allow_archives))
    )


def conditional_reason(cfg: Settings) -> Column:
    """Logged-in visitors (managers may preview an explicit address), noindex, unsupported view."""
    logged_in = F.coalesce(F.col("logged_in"), F.lit(False))
    bypass = F.coalesce(F.col("is_manager"), F.lit(False)) & F.col("is_explicit")
    return _first_reason(
        [
            ("logged_in", F.lit(cfg.disable_logged_in) & logged_in & ~bypass),
            ("noindex", F.lit(cfg.disable_noindex) & F.col("noindex")),
            ("view", ~supported_view(cfg)),
        ]
    )


def decide(requests: DataFrame, cfg: Settings) -> DataFrame:
    """Adds hard_reason, cond_reason, reason, eligible, eligible_alternate and eligible_link
    to classified requests that carry their post's facts."""
    known = requests.withColumn("noindex", F.coalesce(F.col("noindex"), F.lit(False)))
    page_name = F.col("page_name") if "page_name" in requests.columns else None
    judged = known.withColumns(
        {"hard_reason": hard_reason(cfg, page_name), "cond_reason": conditional_reason(cfg), "supported_view": supported_view(cfg)}
    )
    eligible = F.col("hard_reason").isNull() & F.col("cond_reason").isNull()
    links_on = cfg.enabled and (cfg.link_headers_enabled or cfg.head_alternate_link)
    return judged.withColumns(
        {
            "reason": F.coalesce("hard_reason", "cond_reason"),
            "eligible": eligible,
            "eligible_alternate": F.lit(cfg.enabled) & eligible & F.col("supported_view"),
            "eligible_link": F.lit(links_on)
            & F.col("hard_reason").isNull()
            & ~(F.lit(cfg.disable_noindex) & F.col("noindex"))
            & F.col("supported_view"),
        }
    )


def eligibility_audit(decided: DataFrame) -> DataFrame:
    """Requests per method and reason, per reason, and in total.

    Counts per (method, reason) come first, with partial sums on the map side, so the roll-ups read
    a handful of rows and no hot reason travels as rows.
    """
    cells = decided.groupBy(
        F.coalesce("md_method", F.lit("none")).alias("method"), F.coalesce("reason", F.lit("eligible")).alias("reason")
    ).agg(F.count("*").alias("requests"))
    return cells.groupingSets(
        [[F.col("method"), F.col("reason")], [F.col("reason")], []], F.col("method"), F.col("reason")
    ).agg(F.sum("requests").alias("requests"))
