"""DuckDB twins of the registered queries, written on their own: where the Spark jobs use running
windows, these join intervals and compare texts outright."""

from __future__ import annotations

from .views import ARRIVALS

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11)"
DEFAULT_EXCLUDED = "name IN ('nav','header','footer','aside','script','style','noscript','iframe') OR aria = 'true' OR " + " OR ".join(
    f"contains(classes, ' {c} ')" for c in ("site-header", "site-footer", "cookie", "cookies", "sr-only")
)
DEFAULT_RANK = (
    "CASE WHEN name='main' THEN 0 WHEN name='article' THEN 1 WHEN contains(classes,' entry-content ') THEN 2 "
    "WHEN contains(classes,' site-main ') THEN 3 WHEN id='content' THEN 4 WHEN name='body' THEN 5 END"
)
BODY_RANK = "CASE WHEN name='body' THEN 0 END"
BODY_EXCLUDED = DEFAULT_EXCLUDED + " OR contains(classes, ' ad ')"

_MARKUP = (
    # written out without look-ahead: one character after the name, or none before the end tag's '>'
    r"<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}[\s/>].*?(?:</{t}>|</{t}[\s/][^>]*>|\z)" for t in ("script", "style", "noscript", "iframe"))
    + r"""|</?[a-z][^>=]*(?:=\s*(?:"[^"]*"|'[^']*'|)[^>=]*)*>|</?[a-z].*\z|<[!?/][^>]*>|<[!?/][^>]*\z|<|\A"""
)
_SEGMENT = ("(?is)(" + _MARKUP + ")([^<]*)").replace("'", "''")
_START = r"""(?s)^<[^>=]*(?:=\s*(?:"[^"]*"|'[^']*'|)[^>=]*)*>""".replace("'", "''")
_ATTR = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""".replace("'", "''")
BOXES = "('" + "','".join(
    "address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html main menu nav ol pre search section select summary table title ul".split()) + "')"
HEADINGS = "('h1','h2','h3','h4','h5','h6')"
BLOCKS = BOXES[:-1] + ",'p','caption','colgroup','dd','dt','li','optgroup','tbody','tfoot','thead','option','tr')"
EMPTY_TAGS = "('p','div','span','a','li','h1','h2','h3','h4','h5','h6')"


def decode(x: str) -> str:
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{value}')"
    return x


def one_blank(x: str) -> str:
    return rf"regexp_replace({x}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g')"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


AD = '<div class="ad">'
SOURCES = {
    "pages": "SELECT page_id, url, html FROM pages",
    "loose": """SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN replace(h, '<article>',
        '<article><style-guide>Kept</style-guide><noscript-box a="1"/><script>if (a < b) "</p>"</SCRIPT' || chr(10) || ' x><iframe src="i"></iframe ><scripts>Kept</scripts>') ELSE h END
        || CASE page_id % 8 WHEN 1 THEN 'Tail <a href="x" <b id=1 ' WHEN 5 THEN 'Tail <! a <!doc' ELSE '' END AS html
        FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN replace(html, '<html', '<section') ELSE html END AS h FROM pages)""",
    "short": """SELECT page_id, url, html FROM pages UNION ALL
        SELECT -1 - page_id, url || '?short', '<html lang="en"><body><main>Short</main></body></html>' FROM pages WHERE page_id % 7 = 0""",
    "dressed": f"""SELECT page_id, url, replace(replace(html, '{AD}', CASE WHEN page_id % 2 = 0
        THEN '<div class="ad" style="color:red;DISPLAY:none">' ELSE '<div style="display:  none" Data-X="1" onclick="f()" onload="g()">' END), '<article>',
        CASE WHEN page_id % 2 = 0
        THEN '<article><style-guide>Kept</style-guide><script>if (a < b) "</p>"</script x><img src="/i.png?a=1&amp;b=2" alt=" A "><img alt="none" src=" "><p><img src="/lost.png"></p><ol><li>One<li>Two <i>x </i><ul><li>In</ul></ol>'
        ELSE '<article class=" post  entry-content "><p style="display: none">Hidden</p><div><span> </span></div><a href=" JavaScript:x()">S</a><p><a href="/k"></a></p><blockquote><p>Quoted &lt;b&gt;</p></blockquote><pre>a <b>c </b> <a href="/q">l</a><i> d</i>' || chr(10) || '  b</pre><hr><p aria-hidden="true">Off</p>' END) AS html FROM pages""",
}


def tokens(source: str) -> str:
    return rf"""
src AS ({SOURCES[source]}),
doc AS (SELECT page_id, CASE
    WHEN NOT regexp_matches(html, '(?i)<html') THEN '<!DOCTYPE html><html><body>' || html || '</body></html>'
    WHEN regexp_matches(html, '(?i)<body') THEN html
    WHEN regexp_matches(html, '(?i)</head\s*>') THEN regexp_replace(html, '(?i)(</head\s*>)', '\1<body>')
    ELSE regexp_replace(html, '(?i)(<html\b[^>]*>)', '\1<body>') END AS doc FROM src),
cut AS (SELECT page_id, unnest(range(len(a)))::INT AS pos, unnest(a) AS t, unnest(b) AS x
    FROM (SELECT page_id, regexp_extract_all(doc, '{_SEGMENT}', 1) AS a, regexp_extract_all(doc, '{_SEGMENT}', 2) AS b FROM doc)),
stray AS (SELECT *, t = '<' OR (regexp_matches(t, '^</?[A-Za-z]') AND t NOT LIKE '%>' AND NOT regexp_matches(t, '(?i)^<(script|style|noscript|iframe)([\s/>]|$)')) AS s FROM cut),
named AS (SELECT page_id, pos, CASE WHEN s THEN '' ELSE t END AS tag, CASE WHEN s THEN t || x ELSE x END AS txt,
    CASE WHEN s THEN '' ELSE lower(regexp_extract(t, '^</?([A-Za-z][^\s/>]*)', 1)) END AS name FROM stray),
tok AS (SELECT *, CASE WHEN tag = '' THEN 'text' WHEN name = '' THEN 'comment' WHEN starts_with(tag, '</') THEN 'close'
    WHEN name IN ('script','style','noscript','iframe') THEN 'raw'
    WHEN name IN ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr')
      OR regexp_matches(tag, '(?:[\s"'']|^<[^\s=]*)/>$') THEN 'void' ELSE 'open' END AS kind FROM named),
attr0 AS (SELECT page_id, pos, regexp_replace(regexp_replace(regexp_extract(tag, '{_START}', 0), '(?s)^<[^\s/>]+', ''), '/?>$', '') AS tail
    FROM tok WHERE kind IN ('open','void','raw') AND regexp_matches(tag, '^<[A-Za-z][^\s/>]*[\s/]+[^\s/>]')),
attr1 AS (SELECT page_id, pos, unnest(range(len(k))) AS i, unnest(k) AS key, unnest(v) AS v
    FROM (SELECT page_id, pos, regexp_extract_all(lower(tail), '{_ATTR}', 1) AS k, regexp_extract_all(tail, '{_ATTR}', 2) AS v FROM attr0)),
attrs AS (SELECT page_id, pos, key, min(i) AS i, {decode("arg_min(CASE WHEN left(v,1) IN ('\"', '''') THEN substr(v, 2, length(v)-2) ELSE v END, i)")} AS value
    FROM attr1 GROUP BY page_id, pos, key)"""


def elements(source: str) -> str:
    level = "CASE WHEN name IN ('caption','colgroup','dd','dt','li','optgroup','tbody','tfoot','thead') THEN 1 WHEN name IN ('option','tr') THEN 2 WHEN name IN ('td','th') THEN 3 END"
    after = "PARTITION BY page_id, depth ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    return tokens(source) + rf""",
edge AS (SELECT page_id, pos, kind, name, {level} AS lv, name IN {BOXES} AS box, name = 'p' AS para FROM tok WHERE kind IN ('open','close')),
pairs AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, name ORDER BY pos) + CASE kind WHEN 'close' THEN 1 ELSE 0 END AS nest
    FROM edge WHERE lv IS NULL AND NOT para),
mates AS (SELECT page_id, pos, CASE WHEN kind = 'open' AND lead(kind) OVER w = 'close' THEN lead(pos) OVER w END AS mate,
    kind = 'close' AND coalesce(lag(kind) OVER w = 'open', false) AS fits FROM pairs WINDOW w AS (PARTITION BY page_id, name, nest ORDER BY pos)),
deep0 AS (SELECT e.*, m.mate, coalesce(m.fits, false) AS fits, e.box AND e.kind = 'open' AND m.mate IS NOT NULL AS full_box, e.box AND coalesce(m.fits, false) AS box_end
    FROM edge e LEFT JOIN mates m USING (page_id, pos)),
deep AS (SELECT *, sum(CASE WHEN full_box THEN 1 WHEN box_end THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos)
    + CASE WHEN full_box THEN -1 WHEN box_end THEN 1 ELSE 0 END AS depth FROM deep0),
sizes AS (SELECT page_id, max(pos) + 1 AS n FROM tok GROUP BY page_id),
ahead AS (SELECT *, min(CASE WHEN box_end THEN pos END) OVER ({after}) AS nb,
    min(CASE WHEN para OR lv IS NOT NULL OR (box AND kind = 'open') OR box_end THEN pos END) OVER ({after}) AS nblock,
    min(CASE WHEN lv <= 1 THEN pos END) OVER ({after}) AS n1, min(CASE WHEN lv <= 2 THEN pos END) OVER ({after}) AS n2,
    min(CASE WHEN lv <= 3 THEN pos END) OVER ({after}) AS n3 FROM deep),
ends AS (SELECT page_id, pos, name, box, para, lv, CASE WHEN para THEN least(nblock, n) WHEN lv = 1 THEN least(n1, nb, n) WHEN lv = 2 THEN least(n2, nb, n)
    WHEN lv = 3 THEN least(n3, nb, n) WHEN box THEN coalesce(mate, least(nb, n)) ELSE least(mate, n3, nb, n) END AS pend
    FROM ahead JOIN sizes USING (page_id) WHERE kind = 'open'),
within_p AS (SELECT e.page_id, e.pos, max(p.pend) AS p_end FROM ends e JOIN ends p ON p.page_id = e.page_id AND p.para AND p.pos < e.pos AND p.pend > e.pos
    WHERE NOT e.box AND NOT e.para AND e.lv IS NULL GROUP BY e.page_id, e.pos),
el AS (SELECT e.page_id, e.pos, e.name, 'open' AS kind, least(e.pend, w.p_end)::INT AS pend FROM ends e LEFT JOIN within_p w USING (page_id, pos)
    UNION ALL SELECT page_id, pos, name, kind, pos AS pend FROM tok WHERE kind IN ('void','raw'))"""


def texts() -> str:
    body = r"regexp_replace(regexp_replace(tag, '(?s)^<[^>]*>', ''), '</[A-Za-z]+([\s/][^>]*)?>$', '')"
    raw = rf"CASE WHEN kind = 'raw' THEN CASE WHEN name IN ('script','style') THEN {body} ELSE regexp_replace({body}, '<[^>]*>', '', 'g') END ELSE '' END"
    return f""",
lens AS (SELECT e.page_id, e.pos, e.name, e.pend, coalesce(strlen({trim(one_blank("string_agg(t.x, '' ORDER BY t.pos)"))}), 0)::BIGINT AS text_len
    FROM el e LEFT JOIN (SELECT page_id, pos, {raw} || {decode('txt')} AS x FROM tok) t ON t.page_id = e.page_id AND t.pos >= e.pos AND t.pos < e.pend
    WHERE e.kind = 'open' GROUP BY ALL)"""


def flags(rank: str, excluded: str) -> str:
    def value(key: str) -> str:
        return f"max(CASE WHEN key = '{key}' THEN value END)"

    return texts() + rf""",
wide AS (SELECT page_id, pos, {value('id')} AS id, {value('class')} AS class, {value('style')} AS style, {value('href')} AS href, {value('src')} AS src,
    {value('alt')} AS alt, {value('aria-hidden')} AS aria FROM attrs GROUP BY page_id, pos),
fl0 AS (SELECT el.*, w.id, w.href, w.src, w.alt, w.aria, ' ' || {trim(r"regexp_replace(coalesce(w.class,''), '[ \t\r\n]+', ' ', 'g')")} || ' ' AS classes,
    contains(lower(coalesce(w.style,'')), 'display:none') OR contains(lower(coalesce(w.style,'')), 'display: none') AS hidden,
    starts_with(lower({trim("coalesce(w.href,'')")}), 'javascript:') AS script FROM el LEFT JOIN wide w USING (page_id, pos)),
fl AS (SELECT *, {rank} AS rank, coalesce({excluded}, false) AS excluded FROM fl0),
picked AS (SELECT page_id, arg_min({{'rank': rank, 'pos': f.pos, 'pend': f.pend, 'hidden': hidden}}, {{'rank': rank, 'pos': f.pos}}) AS best
    FROM (SELECT page_id, pos, pend, hidden, coalesce(rank, CASE WHEN name='body' THEN 6 END) AS rank FROM fl WHERE kind = 'open') f JOIN lens l USING (page_id, pos)
    WHERE rank IS NOT NULL AND text_len >= 50 GROUP BY page_id),
root AS (SELECT page_id, best.rank AS rank, best.pos AS rpos, best.pend AS rend, best.hidden AS rhidden FROM picked)"""


def cut_out(first: str, second: str | None = None) -> str:
    """first, second: which elements go, in two rounds; the second one sees the text left by the first."""
    out = f""",
in1 AS (SELECT f.*, rhidden, CASE WHEN NOT (script AND NOT rhidden) THEN href END AS target FROM fl f JOIN root r ON f.page_id = r.page_id AND f.pos > r.rpos AND f.pos < r.rend),
bad1 AS (SELECT * FROM in1 WHERE {first}),
el1 AS (SELECT * FROM in1 i WHERE NOT EXISTS (SELECT 1 FROM bad1 b WHERE b.page_id = i.page_id AND ((b.kind = 'open' AND b.pos <= i.pos AND i.pos < b.pend) OR b.pos = i.pos))),
tx1 AS (SELECT t.page_id, t.pos, t.txt, {trim(one_blank(decode('t.txt')))} <> '' AS seen FROM tok t JOIN root r ON t.page_id = r.page_id AND t.pos >= r.rpos AND t.pos < r.rend
    WHERE t.txt <> '' AND NOT EXISTS (SELECT 1 FROM bad1 b WHERE b.page_id = t.page_id AND b.kind = 'open' AND b.pos <= t.pos AND t.pos < b.pend)),
el2 AS (SELECT i.*, NOT EXISTS (SELECT 1 FROM tx1 t WHERE t.page_id = i.page_id AND t.seen AND t.pos >= i.pos AND t.pos < i.pend) AS blank FROM el1 i)"""
    if second:
        out += f""",
bad2 AS (SELECT * FROM el2 WHERE {second}),
el3 AS (SELECT * FROM el2 i WHERE NOT EXISTS (SELECT 1 FROM bad2 b WHERE b.page_id = i.page_id AND ((b.kind = 'open' AND b.pos <= i.pos AND i.pos < b.pend) OR b.pos = i.pos))),
tx3 AS (SELECT * FROM tx1 t WHERE NOT EXISTS (SELECT 1 FROM bad2 b WHERE b.page_id = t.page_id AND b.kind = 'open' AND b.pos <= t.pos AND t.pos < b.pend))"""
    return out


FIRST = "excluded OR (hidden AND NOT rhidden) OR kind = 'raw'"
EMPTY = f"name IN {EMPTY_TAGS} AND blank AND NOT (name = 'a' AND {trim(chr(99) + 'oalesce(target,' + chr(39) * 2 + ')')} <> '')"
SECOND = f"({EMPTY}) OR (name = 'img' AND {trim(chr(99) + 'oalesce(src,' + chr(39) * 2 + ')')} = '')"


def content(source: str, rank: str = DEFAULT_RANK, excluded: str = DEFAULT_EXCLUDED) -> str:
    return elements(source) + flags(rank, excluded) + cut_out(FIRST, SECOND)


def inner_html() -> str:
    esc = "replace(replace(value, '&', '&amp;'), '\"', '&quot;')"
    keep = "(e.rhidden OR NOT (key IN ('onclick','style') OR starts_with(key,'data-') OR (key = 'href' AND e.script)))"
    return f""",
tags AS (SELECT e.page_id, e.pos, '<' || any_value(e.name) || coalesce(string_agg(' ' || key || '="' || {esc} || '"', '' ORDER BY i) FILTER (WHERE key IS NOT NULL AND {keep}), '') || '>' AS s
    FROM el3 e LEFT JOIN attrs a ON a.page_id = e.page_id AND a.pos = e.pos GROUP BY e.page_id, e.pos),
notes AS (SELECT t.page_id, t.pos, t.tag FROM tok t JOIN root r ON t.page_id = r.page_id AND t.pos > r.rpos AND t.pos < r.rend WHERE t.kind = 'comment'
    AND NOT EXISTS (SELECT 1 FROM (SELECT page_id, pos, pend, kind FROM bad1 UNION ALL SELECT page_id, pos, pend, kind FROM bad2) b
      WHERE b.page_id = t.page_id AND b.kind = 'open' AND b.pos <= t.pos AND t.pos < b.pend)),
bits AS (SELECT page_id, pos, 1 AS ph, 0 AS tie, s FROM tags UNION ALL SELECT page_id, pend, 0, -pos, '</' || name || '>' FROM el3 WHERE kind = 'open'
    UNION ALL SELECT page_id, pos, 2, 0, txt FROM tx3 UNION ALL SELECT page_id, pos, 1, 0, tag FROM notes),
html AS (SELECT p.page_id, coalesce({trim("string_agg(s, '' ORDER BY pos, ph, tie)")}, '') AS content FROM src p LEFT JOIN bits b ON b.page_id = p.page_id GROUP BY p.page_id)"""


def markdown(el: str = "el3", tx: str = "tx3") -> str:
    inl = "name IN ('b','strong','i','em','code') AND filled OR (name = 'a' AND value IS NOT NULL)"
    prefix = "repeat('> ', quotes::INT)"
    nl = f"chr(10) || {prefix}"
    lead = f"CASE WHEN place = 'line' THEN {prefix} ELSE '' END"
    raw = "regexp_replace(value, '[\\x01-\\x08]', '', 'g')"
    flat = one_blank(raw)

    def wrap(mark: str) -> str:
        return f"CASE WHEN filled AND pre = 0 THEN {lead} || {mark} ELSE '' END"

    return f""",
ev0 AS (SELECT page_id, pos, 1 AS ph, 0 AS tie, kind AS what, name, CASE WHEN name = 'img' THEN '![' || coalesce(alt,'') || '](' || coalesce(src,'') || ')' WHEN name = 'a' THEN target END AS value, NOT blank AS filled FROM {el}
    UNION ALL SELECT page_id, pend, 0, -pos, 'close', name, CASE WHEN name = 'a' THEN target END, NOT blank FROM {el} WHERE kind = 'open'
    UNION ALL SELECT page_id, pos, 2, 0, 'text', NULL, txt, seen FROM {tx}),
ev1 AS (SELECT *, CASE WHEN what = 'text' THEN CASE WHEN filled THEN 'in' END
      WHEN what = 'open' THEN CASE WHEN name = 'li' OR name IN {HEADINGS} THEN 'mark' WHEN name = 'pre' OR {inl} THEN 'in' END
      WHEN what = 'close' THEN CASE WHEN name IN {BLOCKS} THEN 'line' WHEN name IN ('td','th') OR {inl} THEN 'in' END
      WHEN name IN ('br','hr') THEN 'line' WHEN name = 'img' THEN 'in' END AS solid,
    CASE WHEN what = 'open' AND name IN {BLOCKS} AND name NOT IN ('li','pre') AND name NOT IN {HEADINGS} THEN 'line' END AS plain,
    CASE what WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END AS step FROM ev0),
ev2 AS (SELECT *, last_value(solid IGNORE NULLS) OVER b AS s, last_value(coalesce(solid, plain) IGNORE NULLS) OVER b AS a,
    sum(CASE WHEN name IN ('ul','ol') THEN step ELSE 0 END) OVER w AS ld, sum(CASE WHEN name = 'blockquote' THEN step ELSE 0 END) OVER w AS quotes,
    sum(CASE WHEN name = 'pre' THEN step ELSE 0 END) OVER w AS pre FROM ev1
    WINDOW w AS (PARTITION BY page_id ORDER BY pos, ph, tie), b AS (PARTITION BY page_id ORDER BY pos, ph, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lists AS (SELECT page_id, pos, pend, name FROM {el} WHERE kind = 'open' AND name IN ('ul','ol')),
items AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id, lpos ORDER BY pos) AS no, lname FROM (SELECT i.page_id, i.pos, max(l.pos) AS lpos, arg_max(l.name, l.pos) AS lname
    FROM {el} i JOIN lists l ON l.page_id = i.page_id AND l.pos < i.pos AND l.pend > i.pos WHERE i.name = 'li' AND i.kind = 'open' GROUP BY i.page_id, i.pos)),
ev3 AS (SELECT e.*, CASE WHEN s = 'mark' THEN 'mark' WHEN coalesce(a, 'line') = 'line' THEN 'line' ELSE 'in' END AS place, i.no, i.lname
    FROM ev2 e LEFT JOIN items i ON i.page_id = e.page_id AND i.pos = e.pos AND e.what = 'open'),
ev4 AS (SELECT *, CASE
    WHEN what = 'text' AND pre > 0 THEN CASE WHEN quotes > 0 THEN replace({raw}, chr(10), {nl}) ELSE {raw} END
    WHEN what = 'text' AND NOT filled THEN CASE WHEN place = 'in' THEN {flat} ELSE '' END
    WHEN what = 'text' AND place = 'in' THEN {flat}
    WHEN what = 'text' THEN {lead} || ltrim({flat})
    WHEN what = 'open' AND name = 'li' THEN {nl} || repeat('  ', greatest(ld - 1, 0)::INT) || CASE WHEN lname = 'ol' THEN no || '. ' ELSE '- ' END
    WHEN what = 'open' AND name IN {HEADINGS} THEN CASE WHEN place = 'mark' THEN '' ELSE {nl} END || repeat('#', substr(name,2,1)::INT) || ' '
    WHEN what = 'open' AND name = 'pre' THEN {nl} || '```' || chr(10) || {prefix}
    WHEN what = 'open' AND name IN {BLOCKS} THEN CASE WHEN place = 'mark' THEN '' ELSE chr(10) END
    WHEN what = 'open' AND name IN ('b','strong') THEN {wrap('chr(2)')} WHEN what = 'open' AND name IN ('i','em') THEN {wrap('chr(4)')}
    WHEN what = 'open' AND name = 'code' AND pre = 0 THEN {wrap("'`'")} WHEN what = 'open' AND name = 'a' AND value IS NOT NULL AND pre = 0 THEN {lead} || '['
    WHEN what = 'close' AND name = 'pre' THEN {nl} || '```' || chr(10) WHEN what = 'close' AND name IN {BLOCKS} THEN chr(10) WHEN what = 'close' AND name IN ('td','th') THEN ' '
    WHEN what = 'close' AND name IN ('b','strong') AND filled AND pre = 0 THEN chr(3) WHEN what = 'close' AND name IN ('i','em') AND filled AND pre = 0 THEN chr(5)
    WHEN what = 'close' AND name = 'code' AND pre = 0 AND filled THEN '`' WHEN what = 'close' AND name = 'a' AND value IS NOT NULL AND pre = 0 THEN '](' || value || ')'
    WHEN what = 'void' AND name = 'br' THEN chr(10) WHEN what = 'void' AND name = 'hr' THEN {nl} || '---' || chr(10) WHEN what = 'void' AND name = 'img' THEN {lead} || value
    ELSE '' END AS piece FROM ev3),
md0 AS (SELECT page_id, string_agg(piece, '' ORDER BY pos, ph, tie) AS md, bool_or(what IN ('open','void') OR (what = 'text' AND {trim('value')} <> '')) AS has FROM ev4 GROUP BY page_id),
md AS (SELECT p.page_id, coalesce(replace(replace(replace(replace(regexp_replace(regexp_replace(md, '([' || chr(2) || chr(4) || ']+)(\\s+)', '\\2\\1', 'g'), '(\\s+)([' || chr(3) || chr(5) || ']+)', '\\2\\1', 'g'),
    chr(2), '**'), chr(3), '**'), chr(4), '*'), chr(5), '*'), '') AS md, coalesce(has, false) AS has FROM src p LEFT JOIN md0 ON md0.page_id = p.page_id)"""


def gsub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


STEPS = {
    "m3_demote_h1": lambda x: gsub(x, "(?m)^# ", "## "),
    "m4_tidy_links": lambda x: gsub(x, r"\[\s*([^\]]+?)\s*\]\(\s*([^)]+?)\s*\)", r"[\1](\2)"),
    "m5_drop_empty_images": lambda x: gsub(gsub(gsub(x, r"!\[[^\]]*\]\(\s*\)", ""), r"!\[\s*\]\([^)]+\)", ""), r"(?m)^!\s*$", ""),
    "m6_drop_empty_headings": lambda x: gsub(x, r"(?m)^#+\s*$", ""),
    "m7_drop_empty_links": lambda x: gsub(x, r"\[\s*\]\([^)]*\)", ""),
    "m8_dedent_and_rstrip": lambda x: gsub(gsub(gsub(x, r"(?m)^[ \t]+(#+\s)", r"\1"), r"(?m)^[ \t]+(\[)", r"\1"), r"(?m)[ \t]+$", ""),
    "m9_drop_blank_lines": lambda x: rf"array_to_string(list_filter(regexp_split_to_array({x}, '\r\n|\n|\r'), lambda l: {trim('l')} <> ''), chr(10))",
    "m11_reflow": lambda x: trim(gsub(
        f"regexp_replace({gsub(x, chr(92) + ')' + chr(92) + 's+' + chr(92) + '[', ')' + chr(10) + '[')}, '([^\\n#])\\n(#{{1,6}} )', '\\1' || chr(10) || chr(10) || '\\2', 'g')",
        r"\n{3,}", "\n\n")),
}


def dedupe(df: str, key: str, col: str) -> str:
    """Rows instead of lists: a line goes when it equals the line before."""
    return rf"""lines AS (SELECT {key}, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT {key}, regexp_split_to_array({col}, '\r\n|\n|\r') AS l FROM {df})),
marked AS (SELECT *, coalesce({trim('line')} = {trim('lag(line) OVER (PARTITION BY ' + key + ' ORDER BY i)')} AND {trim('line')} <> '', false) AS again FROM lines),
deduped AS (SELECT {key}, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT again), '') AS {col} FROM marked GROUP BY {key})"""


def cleaned(df: str, key: str, demote: str) -> str:
    """From df(key, md) to done(key, md)."""
    x = decode("md")
    first = f"CASE WHEN {demote} THEN {STEPS['m3_demote_h1'](x)} ELSE {x} END"
    y = "md"
    for name in ("m4_tidy_links", "m5_drop_empty_images", "m6_drop_empty_headings", "m7_drop_empty_links", "m8_dedent_and_rstrip", "m9_drop_blank_lines"):
        y = STEPS[name](y)
    return f"""c1 AS (SELECT * REPLACE ({first} AS md) FROM {df}), c2 AS (SELECT * REPLACE ({y} AS md) FROM c1), {dedupe('c2', key, 'md')},
done AS (SELECT {key}, {STEPS['m11_reflow']('md')} AS md FROM deduped)"""


TITLE = trim(decode(r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"))
LANG = r"""lower(regexp_extract(html, '(?is)<html\b[^>]*\blang\s*=\s*["'']?\s*([A-Za-z][A-Za-z0-9_-]*)', 1))"""
RPATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
SELECTOR_TEXT = "main, article, .entry-content, .site-main, #content, body"
KEY = (
    f"'md_' || md5(concat_ws(chr(1), coalesce(url,''), page_id::VARCHAR, md5(html), {LANG}, '1.0.0', '{SELECTOR_TEXT}', '', '1', '1', '1', '0', 'append'))"
)
POSTS = f"""posts AS (SELECT page_id AS post_id, {HOST} AS host, {RPATH} AS url_path,
    CASE page_id % 5 WHEN 0 THEN 'page' WHEN 3 THEN 'page' WHEN 2 THEN 'case_study' ELSE 'post' END AS post_type,
    CASE page_id % 11 WHEN 7 THEN 'draft' WHEN 8 THEN 'private' WHEN 9 THEN 'future' WHEN 10 THEN 'pending' ELSE 'publish' END AS post_status,
    'post-' || page_id AS post_name, CASE WHEN page_id % 4 = 0 THEN 'About ' || page_id END AS excerpt, html AS post_content, url AS permalink FROM pages)"""
META = "meta AS (SELECT page_id AS post_id, CASE WHEN page_id % 10 = 3 THEN '1' ELSE '0' END AS noindex_value, CASE WHEN page_id % 3 = 0 THEN 'About page ' || page_id END AS description FROM pages)"
WORDS = (
    r"array_to_string(list_slice(regexp_split_to_array(" + trim(r"regexp_replace(regexp_replace(regexp_replace(post_content, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '<[^>]*>', '', 'g')") + r", '\s+'), 1, 55), ' ')"
)
EXCERPT = f"coalesce(excerpt, {trim(WORDS)})"
ABOUT = f"about AS (SELECT post_id AS page_id, coalesce(description, {EXCERPT}) AS description FROM posts JOIN meta USING (post_id))"
REQUESTS = f"""req0 AS (SELECT event_id AS e, ts, user_id, event_id % (SELECT count(*) FROM pages) AS page_id FROM events),
req AS (SELECT e AS request_id, ts, user_id, page_id AS post_id, {HOST} AS host,
    CASE e % 6 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/html, Text/Markdown;q=0' WHEN 2 THEN '' ELSE 'text/html' END AS accept,
    CASE e % 13 WHEN 0 THEN '/.md' WHEN 1 THEN '/sitemap-1.xml' WHEN 2 THEN '/robots.txt' WHEN 3 THEN '/wp-login.php' WHEN 4 THEN {RPATH} || '.md'
      WHEN 5 THEN {RPATH} || '.MD/' WHEN 6 THEN {RPATH} || '?format=Markdown' WHEN 7 THEN {RPATH} || '?a=1&output=markdown' ELSE {RPATH} END AS uri,
    CASE e % 17 WHEN 0 THEN '404' WHEN 1 THEN 'search' WHEN 2 THEN 'archive' WHEN 3 THEN 'feed' WHEN 4 THEN 'preview' WHEN 5 THEN 'admin' WHEN 6 THEN 'front_page' WHEN 7 THEN 'home' ELSE 'singular' END AS view,
    user_id % 7 = 0 AS logged_in, user_id % 14 = 0 AS is_manager, e % 19 = 0 AS password_required FROM req0 JOIN pages USING (page_id)),
cls0 AS (SELECT *, split_part(split_part(uri, '#', 1), '?', 1) AS path, accept ILIKE '%text/markdown%' AS wants_accept,
    uri ILIKE '%?format=markdown' OR uri ILIKE '%&output=markdown' AS wants_query FROM req),
cls AS (SELECT *, lower(path) LIKE '%.md' OR lower(path) LIKE '%.md/' AS wants_url,
    CASE WHEN path = '/.md' THEN '' WHEN path LIKE '%.md' THEN ltrim(left(path, length(path) - 3), '/') END AS md_path FROM cls0),
asked AS (SELECT *, CASE WHEN wants_accept THEN 'accept' WHEN wants_url THEN 'url' WHEN wants_query THEN 'query' WHEN coalesce(md_path, '') <> '' THEN 'rewrite' END AS md_method,
    wants_url OR wants_query OR coalesce(md_path, '') <> '' AS is_explicit FROM cls)"""


def decided(allow_search: bool = False, disable_logged_in: bool = True) -> str:
    return f"""{POSTS}, {META}, {REQUESTS},
dec0 AS (SELECT a.*, post_type, post_status, permalink, noindex_value = '1' AS noindex FROM asked a JOIN posts USING (post_id) JOIN meta USING (post_id)),
dec1 AS (SELECT *, CASE WHEN view = 'admin' THEN 'admin' WHEN view = 'feed' THEN 'feed' WHEN path = '/sitemap-1.xml' THEN 'sitemap' WHEN path = '/robots.txt' THEN 'robots'
      WHEN path = '/wp-login.php' THEN 'auth' WHEN view IN ('preview', '404') THEN view WHEN view = 'search' AND NOT {allow_search} THEN view WHEN view = 'archive' THEN view
      WHEN password_required THEN 'password' WHEN post_status <> 'publish' THEN 'status' WHEN post_type = 'case_study' THEN 'post_type' END AS hard_reason,
    view IN ('singular','front_page','home') OR (view = 'search' AND {allow_search}) AS supported_view FROM dec0),
dec AS (SELECT *, CASE WHEN {disable_logged_in} AND logged_in AND NOT (is_manager AND is_explicit) THEN 'logged_in' WHEN noindex THEN 'noindex' WHEN NOT supported_view THEN 'view' END AS cond_reason FROM dec1),
judged AS (SELECT *, coalesce(hard_reason, cond_reason) AS reason, hard_reason IS NULL AND cond_reason IS NULL AS eligible,
    hard_reason IS NULL AND NOT noindex AND supported_view AS eligible_link FROM dec)"""


STORE = f"""store AS (SELECT CASE WHEN page_id % 6 = 5 THEN 'old_' ELSE '' END || {KEY} AS cache_key, page_id, {LANG} AS language,
    CASE WHEN page_id % 13 = 0 THEN '' ELSE '# Page ' || page_id END AS markdown, TIMESTAMP '2024-01-01' + to_days((page_id % 29)::INT) AS stored_at,
    (86400 * (1 + page_id % 5))::INT AS ttl_s FROM pages WHERE page_id % 4 <> 3),
live AS (SELECT * FROM store WHERE markdown <> '' AND stored_at + to_seconds(ttl_s) > TIMESTAMP '2024-01-20'),
keyed AS (SELECT page_id, {KEY} AS cache_key FROM pages)"""
CHANGES = f"""{POSTS},
changes AS (SELECT event_id AS change_id, ts, CASE event_id % 4 WHEN 0 THEN 'settings' WHEN 1 THEN 'post_deleted' ELSE 'post_saved' END AS kind, user_id - 3 AS post_id FROM events WHERE event_type = 'error'),
inval AS (SELECT * FROM changes WHERE kind = 'settings' OR (post_id > 0 AND post_id IN (SELECT post_id FROM posts WHERE post_type <> 'case_study'))),
emptied AS (SELECT max(ts) AS gone_at FROM inval WHERE ts <= TIMESTAMP '2024-01-20')"""
ROUTES = f"""{POSTS}, {REQUESTS},
idx AS (SELECT host, trim(url_path, '/') AS resolved, min(CASE WHEN post_type = 'page' THEN post_id END) AS pm, min(post_id) AS um FROM posts GROUP BY ALL),
want AS (SELECT request_id, host, trim(md_path, '/') AS p FROM asked WHERE md_path IS NOT NULL),
wanted AS (SELECT request_id, host, p, CASE WHEN lower(p) LIKE '%.md' THEN rtrim(left(p, length(p) - 3), '/') ELSE p END AS resolved FROM want),
hit AS (SELECT w.*, pm, um, t.post_type, t.post_name FROM wanted w LEFT JOIN idx i ON w.p <> '' AND i.host = w.host AND i.resolved = w.resolved LEFT JOIN posts t ON t.post_id = i.um),
routes AS (SELECT request_id, resolved, CASE WHEN p = '' THEN 'front_page' WHEN resolved = '' THEN 'blank' WHEN pm IS NOT NULL OR post_type = 'page' THEN 'page' WHEN um IS NOT NULL THEN 'post' ELSE 'name' END AS target_kind,
    CASE WHEN p = '' THEN 7 ELSE coalesce(pm, um) END AS target_id,
    CASE WHEN pm IS NOT NULL THEN 'page' ELSE post_type END AS target_type,
    CASE WHEN p = '' THEN NULL WHEN pm IS NOT NULL OR post_type = 'page' THEN resolved WHEN um IS NOT NULL THEN post_name ELSE regexp_extract(resolved, '[^/]*$', 0) END AS target_name,
    CASE WHEN pm IS NULL AND post_type = 'case_study' THEN 'case_study' END AS target_var FROM hit)"""
MD_URL = r"""regexp_extract(url, '^([a-z]+://)', 1) || regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#]*)', 1)
    || CASE WHEN rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') END || '.md' || regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1)"""
FLAWS = (
    "chr(10) || '[  a b ](  /x )' || chr(10) || '![](u)' || chr(10) || '![pic]( )' || chr(10) || '![ ](u)' || chr(10) || '!  ' || chr(10) || '##  ' || chr(10) || '[ ](y)' || chr(10) || '   ## H' || chr(10) || chr(9) "
    "|| '[q](r)  [s](t)  ' || chr(10) || 'Twice' || chr(10) || ' Twice ' || chr(10) || '# Top' || chr(10) || chr(10) || chr(10) || '# Next' || chr(13) || chr(10) || 'End' || chr(13) || 'of &amp;lt; it '"
)
ROUGH = f"rough AS (SELECT doc_id, '# ' || text || {FLAWS} || text AS md FROM documents)"


def corpus_sql(source: str, description: bool) -> str:
    about = f", {POSTS}, {META}, {ABOUT}" if description else ", about AS (SELECT page_id, '' AS description FROM src)"
    return f"""{content(source)}{markdown()}, titled AS (SELECT page_id, md, {TITLE} AS title FROM md JOIN src USING (page_id)),
{cleaned('titled', 'page_id', "title <> ''").replace('SELECT page_id, generate', 'SELECT page_id, generate')}{about},
corpus AS (SELECT page_id, {LANG} AS language, CASE WHEN has THEN 'ok' ELSE 'no_content' END AS status, url,
    CASE WHEN has THEN CASE WHEN {TITLE} <> '' THEN '# ' || {TITLE} || chr(10) || chr(10) ELSE '' END || 'Source: ' || url || chr(10) || chr(10)
      || CASE WHEN description <> '' THEN {decode('description')} || chr(10) || chr(10) ELSE '' END || done.md END AS markdown
    FROM src JOIN md USING (page_id) JOIN done USING (page_id) JOIN about USING (page_id))"""


def _kept(name: str) -> str:
    return f"SELECT page_id, pos, name FROM {name} WHERE kind <> 'raw'"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["s1_read_pages"] = "SELECT page_id, url, strlen(html)::INT AS bytes, md5(html) AS html_md5 FROM pages"
    q["s2_last_nonblank_capture"] = """WITH c AS (SELECT url, page_id * 3 AS no, html FROM pages UNION ALL SELECT url, page_id * 3 + 1, html || '<!-- later -->' FROM pages WHERE page_id % 3 <> 0)
        SELECT url, md5(arg_max(html, no)) AS html_md5 FROM c GROUP BY url"""
    q["s3_read_requests"] = f"WITH {REQUESTS} SELECT request_id, accept, uri FROM req"
    q["s4_post_meta_wide"] = f"WITH {META} SELECT * FROM meta"
    q["s5_write_corpus"] = f"WITH {corpus_sql('short', False)} SELECT page_id, language, md5(markdown) AS markdown_md5 FROM corpus WHERE status = 'ok'"
    q["s6_quarantine"] = f"WITH {corpus_sql('short', False)} SELECT page_id, url, status FROM corpus WHERE status <> 'ok'"
    q["e1_wrap_fragment"] = f"WITH {tokens('loose')} SELECT page_id, md5(CASE WHEN contains(lower(html), '<html') THEN html ELSE '<!DOCTYPE html><html><body>' || html || '</body></html>' END) AS html_md5 FROM src"
    q["e2_html_tokens"] = f"WITH {tokens('loose')} SELECT page_id, pos, kind, name, md5(tag) AS tag_md5, md5(txt) AS txt_md5 FROM tok"
    q["e3_html_elements"] = f"WITH {elements('dressed')} SELECT page_id, pos, pend, name FROM el"
    q["e4_token_attrs"] = f"WITH {tokens('dressed')} SELECT page_id, pos, key, value FROM attrs"
    hits = " UNION ALL ".join(
        f"SELECT page_id, pos, name, {r} AS rank, '{s}' AS selector FROM f WHERE {w}"
        for r, s, w in (
            (0, "article", "name = 'article'"), (1, ".ad", "classes LIKE '% ad %'"), (2, ".ad x", "classes LIKE '% ad x %'"), (3, "#top", "id = 'top'"),
            (4, '[lang="en"]', "lang = 'en'"), (7, '[href="/The"]', "href = '/The'"), (9, "h1", "name = 'h1'"), (11, "li", "name = 'li'"),
        )
    )
    q["e6_match_selectors"] = f"""WITH {tokens('pages')}, f AS (SELECT t.page_id, t.pos, t.name, ' ' || coalesce(max(value) FILTER (WHERE key = 'class'), '') || ' ' AS classes,
        max(value) FILTER (WHERE key = 'id') AS id, max(value) FILTER (WHERE key = 'lang') AS lang, max(value) FILTER (WHERE key = 'href') AS href
        FROM tok t LEFT JOIN attrs a ON a.page_id = t.page_id AND a.pos = t.pos WHERE kind IN ('open','void','raw') GROUP BY t.page_id, t.pos, t.name) {hits}"""
    compiled = (
        (0, "article", "tag", "article", ""), (1, ".ad", "class", "", "ad"), (2, ".ad x", "class", "", "ad x"), (3, "#top", "id", "", "top"),
        (4, '[lang="en"]', "attr", "lang", "en"), (5, "div.x", None, None, None), (6, "main p", None, None, None), (7, '[href="/The"]', "attr", "href", "/The"),
        (8, "H1", "tag", "H1", ""), (9, "h1", "tag", "h1", ""), (10, "my-tag", None, None, None), (11, "li", "tag", "li", ""),
    )
    rows = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in row) + ")" for row in compiled)
    q["e5_compile_selectors"] = f"""SELECT v.*, coalesce(n, 0) AS elements FROM (VALUES {rows}) v(rank, selector, kind, key, value)
        LEFT JOIN (SELECT rank, count(*) AS n FROM ({q["e6_match_selectors"]}) GROUP BY rank) USING (rank)"""
    q["e6_selector_index"] = f"""WITH {tokens('pages')} SELECT '[href="' || a.value || '"]' AS selector, t.name, count(*) AS elements
        FROM attrs a JOIN tok t USING (page_id, pos) WHERE a.key = 'href' GROUP BY ALL"""
    q["e7_meaningful_documents"] = f"SELECT doc_id, strlen({trim(one_blank('text'))}) >= 50 AS meaningful FROM documents"
    q["e7_meaningful_text"] = f"WITH {elements('pages')}{texts()} SELECT page_id, pos, name, text_len, text_len >= 50 AS meaningful FROM lens"
    q["e8_pick_content"] = f"WITH {elements('short')}{flags(DEFAULT_RANK, DEFAULT_EXCLUDED)} SELECT page_id, rank, rpos AS pstart, rend AS pend FROM root"
    q["e9_drop_excluded"] = f"WITH {elements('dressed')}{flags(BODY_RANK, BODY_EXCLUDED)}{cut_out('excluded')} {_kept('el1')}"
    q["e10_drop_hidden"] = f"WITH {elements('dressed')}{flags(BODY_RANK, BODY_EXCLUDED)}{cut_out('hidden AND NOT rhidden')} {_kept('el1')}"
    esc = "replace(replace(value, '&', '&amp;'), '\"', '&quot;')"
    q["e11_sanitize_attrs"] = f"""WITH {tokens('dressed')} SELECT page_id, pos, '<' || any_value(t.name) || coalesce(string_agg(' ' || key || '="' || {esc} || '"', '' ORDER BY i) FILTER
        (WHERE NOT (key IN ('onclick','style') OR starts_with(key,'data-') OR (key = 'href' AND starts_with(lower({trim('value')}), 'javascript:')))), '') || '>' AS start_tag
        FROM attrs JOIN tok t USING (page_id, pos) GROUP BY page_id, pos"""
    q["e12_drop_empty_elements"] = f"WITH {elements('dressed')}{flags(DEFAULT_RANK, DEFAULT_EXCLUDED)}{cut_out(FIRST, EMPTY)} {_kept('el3')}"
    q["e13_drop_srcless_images"] = f"WITH {content('dressed')} {_kept('el3')}"
    q["e14_inner_html"] = f"WITH {content('dressed', BODY_RANK, BODY_EXCLUDED)}{inner_html()} SELECT page_id, md5(content) AS content_md5, strlen(content)::INT AS bytes FROM html"
    q["e15_extract_content"] = f"WITH {content('pages')}{inner_html()} SELECT page_id, md5(content) AS content_md5, strlen(content)::INT AS bytes FROM html"
    q["e16_selector_coverage"] = f"""WITH {elements('short')}{flags(DEFAULT_RANK, DEFAULT_EXCLUDED)} SELECT CASE rank WHEN 0 THEN 'main' WHEN 1 THEN 'article' WHEN 2 THEN '.entry-content' WHEN 3 THEN '.site-main'
        WHEN 4 THEN '#content' WHEN 5 THEN 'body' WHEN 6 THEN 'body (fallback)' ELSE 'none' END AS selector, count(*) AS pages FROM src LEFT JOIN root USING (page_id) GROUP BY 1"""
    q["m1_render_markdown"] = f"WITH {content('dressed')}{markdown()} SELECT page_id, md5(md) AS markdown_md5 FROM md"
    q["m2_decode_entities"] = f"SELECT page_id, md5({decode('html')}) AS html_md5 FROM pages"
    for name, step in STEPS.items():
        q[name] = f"WITH {ROUGH} SELECT doc_id, md5({step('md')}) AS md_md5 FROM rough"
    q["m10_dedupe_adjacent_lines"] = f"WITH {ROUGH}, {dedupe('rough', 'doc_id', 'md')} SELECT doc_id, md5(md) AS md_md5 FROM deduped"
    q["m12_clean_markdown"] = f"WITH {ROUGH}, {cleaned('rough', 'doc_id', 'doc_id % 2 = 0')} SELECT doc_id, md5(md) AS md_md5 FROM done"
    q["m13_page_language"] = f"SELECT page_id, {LANG} AS language FROM pages"  # what the query puts in front must not count
    q["m13_page_title"] = f"SELECT page_id, {TITLE} AS title FROM pages"  # what the query puts in front must not count
    q["m14_excerpt"] = f"WITH {POSTS} SELECT post_id, {EXCERPT} AS excerpt FROM posts"
    q["m15_meta_description"] = f"WITH {POSTS}, {META}, {ABOUT} SELECT page_id, description FROM about"
    q["m16_lead_image"] = f"""WITH {content('dressed')}{inner_html()}, found AS (SELECT page_id, regexp_extract(content, '(?i)<img[^>]+src="([^"]+)"[^>]*>', 0) AS img FROM html)
        SELECT page_id, CASE WHEN img = '' THEN '' ELSE '![' || trim(regexp_extract(img, '(?i)alt="([^"]*)"', 1)) || '](' || regexp_extract(img, '(?i)src="([^"]+)"', 1) || ')' END AS image FROM found"""
    q["m17_front_matter"] = f"""WITH {POSTS}, {META}, {ABOUT} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '![A](/i.png)' || chr(10) || chr(10) ELSE '' END || CASE WHEN {TITLE} <> '' THEN '# ' || {TITLE} || chr(10) || chr(10) ELSE '' END
        || 'Source: ' || url || chr(10) || chr(10) || CASE WHEN description <> '' THEN {decode('description')} || chr(10) || chr(10) ELSE '' END || 'Body' AS markdown FROM pages JOIN about USING (page_id)"""
    # the extracted HTML of a page converts to what the page itself gives
    q["m18_convert"] = f"WITH {corpus_sql('dressed', False)} SELECT page_id, md5(markdown) AS markdown_md5 FROM corpus"
    q["m19_conversion_outcome"] = f"WITH {corpus_sql('short', False)} SELECT status, count(*) AS pages FROM corpus GROUP BY status"
    q["m21_build_corpus"] = f"WITH {corpus_sql('pages', True)} SELECT page_id, language, status, md5(markdown) AS markdown_md5, strlen(markdown)::INT AS bytes FROM corpus"
    for name, col in (
        ("r1_request_path", "path"), ("r2_wants_md_accept", "wants_accept"), ("r3_wants_md_url", "wants_url"), ("r4_wants_md_query", "wants_query"),
        ("r5_md_rewrite_path", "md_path"), ("r6_md_method", "md_method"), ("r7_is_explicit", "is_explicit"),
    ):
        q[name] = f"WITH {REQUESTS} SELECT request_id, {col} FROM asked"
    q["r8_special_paths"] = f"WITH {REQUESTS} SELECT request_id, path LIKE '%sitemap%.xml' AS is_sitemap, path = '/robots.txt' AS is_robots, path LIKE '%wp-login.php%' OR request_id % 23 = 0 AS is_auth FROM asked"
    q["r9_type_allowed"] = f"WITH {POSTS} SELECT post_id, post_type = 'page' AS allowed FROM posts"
    q["r10_hard_exclusion"] = f"WITH {decided()} SELECT request_id, hard_reason FROM judged"
    q["r11_is_noindex"] = f"WITH {META} SELECT post_id, CASE post_id % 6 WHEN 0 THEN true WHEN 1 THEN false ELSE noindex_value = '1' END AS noindex FROM meta"
    q["r12_supported_view"] = f"WITH {decided(allow_search=True)} SELECT request_id, supported_view FROM judged"
    q["r13_conditional_exclusion"] = f"WITH {decided()} SELECT request_id, cond_reason FROM judged"
    q["r14_eligible"] = f"WITH {decided()} SELECT request_id, eligible FROM judged"
    q["r15_eligible_alternate"] = f"WITH {decided(disable_logged_in=False)} SELECT request_id, eligible AND supported_view AS eligible_alternate FROM judged"
    q["r16_eligible_link"] = f"WITH {decided()} SELECT request_id, eligible_link FROM judged"
    q["r17_representation"] = f"""WITH {decided()}, {STORE} SELECT CASE WHEN md_method IS NOT NULL AND eligible THEN CASE WHEN post_id IN (SELECT k.page_id FROM keyed k WHERE k.cache_key IN (SELECT cache_key FROM live))
        THEN 'stored_markdown' ELSE 'fresh_markdown' END WHEN eligible_link THEN 'html_with_link' ELSE 'html' END AS plan, count(*) AS requests FROM judged GROUP BY 1"""
    q["r19_eligibility_audit"] = f"""WITH {decided()}, named AS (SELECT coalesce(md_method, 'none') AS method, coalesce(reason, 'eligible') AS reason FROM judged)
        SELECT method, reason, count(*)::BIGINT AS requests FROM named GROUP BY GROUPING SETS ((method, reason), (reason), ())"""
    q["j1_resolve_route"] = f"WITH {ROUTES} SELECT request_id, resolved, target_kind, target_id FROM routes"
    q["j1_page_paths"] = """WITH RECURSIVE p AS (SELECT page_id AS post_id, 'p' || page_id AS slug, CASE WHEN page_id > 1 AND page_id % 41 = 0 THEN page_id + 1
            WHEN page_id > 1 AND page_id % 41 = 1 THEN page_id - 1 WHEN page_id % 17 = 0 THEN -page_id ELSE page_id // 2 END AS parent_id FROM pages),
        walk AS (SELECT post_id, slug AS path FROM p WHERE parent_id = 0 OR parent_id NOT IN (SELECT post_id FROM p)
            UNION ALL SELECT p.post_id, walk.path || '/' || p.slug FROM p JOIN walk ON p.parent_id = walk.post_id WHERE p.parent_id <> 0)
        SELECT post_id, path FROM p LEFT JOIN walk USING (post_id)"""
    q["j2_resolve_front_page"] = f"WITH {ROUTES} SELECT request_id, target_id FROM routes WHERE target_kind = 'front_page'"
    q["j3_route_target"] = f"WITH {ROUTES} SELECT request_id, target_type, target_name, target_var FROM routes"
    q["j4_canonical_url"] = f"""WITH {decided()} SELECT request_id, CASE WHEN view = 'singular' THEN permalink WHEN view IN ('front_page','home') THEN 'https://example.com/'
        WHEN trim(path,'/') <> '' THEN 'https://example.com/' || trim(path,'/') || '/' ELSE '' END AS canonical_url FROM judged"""
    q["j5_markdown_url"] = f"SELECT page_id, {MD_URL} AS markdown_url FROM pages"
    q["j6_alternate_index"] = f"""SELECT page_id, u AS markdown_url, 'Link: <' || u || '>; rel="alternate"; type="text/markdown"' AS link_header,
        '<link rel="alternate" type="text/markdown" href="' || replace(u, '&', '&amp;') || '" />' AS link_tag FROM (SELECT page_id, {MD_URL} AS u FROM pages)"""
    q["j7_alternate_overrides"] = f"SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'https://cdn.example.net/' || page_id || '.md' ELSE {MD_URL} END AS markdown_url FROM pages"
    q["j8_stale_entries"] = f"WITH {STORE}, {CHANGES} SELECT cache_key, page_id, stored_at <= (SELECT gone_at FROM emptied) AS stale FROM store"
    history = """history AS (SELECT * FROM store UNION ALL SELECT cache_key, page_id, language, CASE WHEN page_id % 10 = 4 THEN '' ELSE 'again' END,
        stored_at + INTERVAL 126 HOUR, 43200 FROM store WHERE page_id % 2 = 0)"""
    q["j8_valid_spans"] = f"""WITH {STORE}, {CHANGES}, {history}, next_ AS (SELECT h.page_id, h.stored_at, min(i.ts) AS gone FROM history h LEFT JOIN inval i ON i.ts >= h.stored_at GROUP BY ALL)
        SELECT cache_key, page_id, strftime(stored_at, '%Y-%m-%d %H:%M:%S') AS stored_at,
            epoch_us(CASE WHEN markdown = '' THEN stored_at WHEN gone < stored_at + to_seconds(ttl_s) THEN gone ELSE stored_at + to_seconds(ttl_s) END) AS valid_until_us
        FROM history JOIN next_ USING (page_id, stored_at)"""
    q["r17_representation_at"] = f"""WITH {decided()}, {STORE}, {CHANGES.replace(POSTS + ',', '')}, {history},
        sunday AS (SELECT ts FROM inval WHERE dayofweek(ts) = 0 AND hour(ts) = 2),
        own AS (SELECT h.*, k.page_id AS post_id FROM history h JOIN keyed k USING (cache_key)),
        last_ AS (SELECT j.request_id, max(stored_at) AS stored_at FROM judged j JOIN own o ON o.post_id = j.post_id AND o.stored_at <= j.ts GROUP BY ALL),
        has AS (SELECT j.request_id FROM judged j JOIN last_ l USING (request_id) JOIN own o ON o.post_id = j.post_id AND o.stored_at = l.stored_at
            WHERE o.markdown <> '' AND o.stored_at + to_seconds(o.ttl_s) > j.ts AND NOT EXISTS (SELECT 1 FROM sunday s WHERE s.ts >= o.stored_at AND s.ts <= j.ts))
        SELECT request_id, request_id IN (SELECT request_id FROM has) AS has_entry, CASE WHEN md_method IS NOT NULL AND eligible THEN
            CASE WHEN request_id IN (SELECT request_id FROM has) THEN 'stored_markdown' ELSE 'fresh_markdown' END
            WHEN eligible_link THEN 'html_with_link' ELSE 'html' END AS plan FROM judged"""
    q["j9_pages_to_refresh"] = f"WITH {STORE}, {CHANGES} SELECT page_id, cache_key FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM live WHERE stored_at > (SELECT gone_at FROM emptied))"
    q["l1_viewable_types"] = f"WITH {POSTS} SELECT post_type, count(*) AS posts, CASE post_type WHEN 'page' THEN 'Page' WHEN 'post' THEN 'Post' ELSE 'case Study' END AS label, CASE post_type WHEN 'page' THEN 2 WHEN 'post' THEN 3 ELSE 1 END AS place FROM posts GROUP BY post_type"
    q["c1_cache_key"] = f"SELECT page_id, {KEY} AS cache_key FROM pages"
    spoken = "CASE WHEN page_id % 3 > 0 THEN 'xx-' || page_id % 3 ELSE '' END"
    q["c1_given_language"] = f"SELECT page_id, {KEY.replace(LANG, spoken)} AS cache_key, {spoken} AS language FROM pages"
    q["c2_upsert_entries"] = f"""WITH {STORE}, both_ AS (SELECT cache_key, page_id, markdown, stored_at, 0 AS fresh FROM store UNION ALL SELECT cache_key, page_id, 'new ' || page_id,
        CASE WHEN page_id % 2 = 0 THEN TIMESTAMP '2024-01-20' ELSE TIMESTAMP '2023-12-01' END, 1 FROM store WHERE page_id % 3 = 0)
        SELECT cache_key, page_id, markdown, strftime(stored_at, '%Y-%m-%d %H:%M:%S') AS stored_at FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY stored_at DESC, fresh DESC) AS rn FROM both_) WHERE rn = 1"""
    q["c2_upsert_store"] = q["c2_upsert_entries"].replace("WHERE page_id % 3 = 0)", "WHERE page_id % 3 = 0 AND regexp_extract(cache_key, 'md_(.)', 1) IN ('0','1','2','3','4','5','6','7'))")
    q["s6_refresh_twice"] = f"""WITH {corpus_sql('short', False)}, first_ AS (SELECT page_id, status FROM corpus)
        SELECT 1::INT AS refresh, status, count(*) AS made FROM first_ GROUP BY status
        UNION ALL SELECT 3::INT, status, count(*) FROM first_ WHERE page_id % 5 = 0 GROUP BY status"""
    q["c3_live_entries"] = f"WITH {STORE} SELECT cache_key, page_id FROM live"
    q["c4_clear_all"] = f"""WITH {STORE} SELECT 'before' AS state, count(*) AS entries, count(DISTINCT cache_key) AS keys FROM store
        UNION ALL SELECT 'current', 0, 0 UNION ALL SELECT 'first version', count(*), count(DISTINCT cache_key) FROM store"""
    q["c5_invalidation_filter"] = f"WITH {CHANGES} SELECT change_id, kind, post_id FROM inval"
    q["c6_refresh_corpus"] = f"""WITH {corpus_sql('pages', False)}, {STORE}, {CHANGES},
        valid AS (SELECT * FROM live WHERE stored_at > (SELECT gone_at FROM emptied))
        SELECT cache_key, page_id, language, md5(markdown) AS markdown_md5, strftime(stored_at, '%Y-%m-%d %H:%M:%S') AS stored_at FROM valid
        UNION ALL SELECT k.cache_key, page_id, language, md5(markdown), '2024-01-20 00:00:00' FROM corpus JOIN keyed k USING (page_id) WHERE k.cache_key NOT IN (SELECT cache_key FROM valid)"""
    # arrivals of each page in order of batch and time; what is kept moves the time from which the next one counts
    batches = ", ".join(f"({i}, {part}, TIMESTAMP '{day}' + to_hours({h}))" for i, (part, day, hours) in enumerate(ARRIVALS) for h in hours)
    q["t1_convert_stream"] = f"""WITH RECURSIVE {corpus_sql('pages', False)},
        seen AS (SELECT page_id, at_, row_number() OVER (PARTITION BY page_id ORDER BY batch, at_) AS n
            FROM pages JOIN (VALUES {batches}) v(batch, part, at_) ON part = 4 OR page_id % 4 = part),
        walk AS (SELECT page_id, n, at_, true AS kept, at_ + INTERVAL 1 DAY AS until FROM seen WHERE n = 1
            UNION ALL SELECT s.page_id, s.n, s.at_, s.at_ >= w.until, CASE WHEN s.at_ >= w.until THEN s.at_ + INTERVAL 1 DAY ELSE w.until END
            FROM walk w JOIN seen s ON s.page_id = w.page_id AND s.n = w.n + 1)
        SELECT page_id, status, md5(markdown) AS markdown_md5, strftime(at_, '%Y-%m-%d %H:%M:%S') AS stored_at FROM corpus JOIN walk USING (page_id) WHERE kept"""
    q["t2_classify_stream"] = f"WITH {decided()} SELECT request_id, md_method, reason, eligible, eligible_link FROM judged"
    q["t2_facts_that_change"] = f"""WITH {decided()}, later AS (SELECT *, day(ts) > 15 AND post_id % 3 = 0 AS now_draft FROM judged)
        SELECT request_id, CASE WHEN now_draft AND coalesce(hard_reason, 'post_type') = 'post_type' THEN 'status' ELSE reason END AS reason,
            CASE WHEN now_draft THEN false ELSE eligible END AS eligible FROM later"""
    q["t3_eligibility_by_window"] = f"""WITH {decided()} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, coalesce(reason, 'eligible') AS reason, count(*) AS requests
        FROM judged GROUP BY 1, 2"""
    return q


ORACLES = build()
