"""DuckDB statements of the same computations, used as correctness oracles.

``sql(body, *ctes)`` prefixes ``body`` with the named CTEs and everything they
depend on. The page-parse CTE is the regular-expression form of the parser;
it is valid for the derived pages (one ``<article>``, plain ``<body>``, the
entities they use, one known sidebar of 9 characters), which is what the oracle runs on.
"""

from __future__ import annotations

from docscope.plans.fixtures import (CATALOG_RAW, CATALOG_RAW_PREVIOUS, CONTENT_TYPE, DOC_HOST, META_MODIFIED,
                                     META_TYPE, META_VERSION, RICH_HTML, SIDEBAR)

PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"
STRIP_BLOCKS = (r"(?s)<(script|style|nav|header|footer|noscript|form)\b.*?"
                r"</(script|style|nav|header|footer|noscript|form)>")


def _dec(x: str) -> str:
    return (f"regexp_replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&amp;?', '&', 'g')")


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _pieces(f: str) -> str:
    return ("list_filter(list_transform(string_split(regexp_replace(regexp_replace(" + f +
            f", '{STRIP_BLOCKS}|<!--.*?-->', chr(1), 'g'), '<[^>]*>', chr(1), 'g'), chr(1)), "
            "lambda x: " + _strip(_dec("x")) + "), lambda x: x <> '')")


def _catalog_values(rows) -> str:
    vals = []
    for i, (pid, title, root, versions, excl) in enumerate(rows):
        items = [s.strip() for s in excl.strip("[]").split(",") if s.strip()]
        arr = "[" + ", ".join(f"'{s}'" for s in items) + "]::VARCHAR[]" if items else "[]::VARCHAR[]"
        vals.append(f"({i}, '{pid}', '{title}', '{root}', '{versions}', {arr})")
    return ("SELECT * FROM (VALUES " + ", ".join(vals) +
            ") t(ord, pid, title, root_path, versions, exclude)")


def _plan(cat: str, prefix: str) -> dict:
    """CTEs m/v/al/plan over catalog ``cat``, names prefixed."""
    p = prefix
    return {
        f"{p}m": (f"""SELECT c.pid, c.title AS product_title, c.root_path, c.versions, c.ord AS pord,
  u.url, u.uord, u.path,
  list_filter(string_split(u.path, '/'), lambda x: regexp_matches(x, '^[0-9]+[.][0-9]+([.][0-9]+)?$')) AS segs
FROM u JOIN {cat} c ON (starts_with(u.path, '/en/' || c.root_path || '/')
    OR ends_with(rtrim(u.path, '/'), '/en/' || c.root_path))
  AND len(list_filter(c.exclude, lambda x: contains(u.url, x))) = 0
  AND NOT (contains(u.url, '/ja-jp/') OR contains(u.url, '/ja/'))""", ["u", cat]),
        f"{p}v": (f"""SELECT pid, seg, CASE WHEN versions IN ('none', '') THEN 1 ELSE CAST(versions AS INTEGER) END AS n,
  row_number() OVER (PARTITION BY pid ORDER BY list_transform(string_split(seg, '.'), lambda x: CAST(x AS INTEGER)) DESC, seg DESC) AS rk
FROM (SELECT DISTINCT pid, versions, unnest(segs) AS seg FROM {p}m) q WHERE versions <> 'all'""", [f"{p}m"]),
        f"{p}al": (f"SELECT pid, list(seg) AS allow FROM {p}v WHERE rk <= n GROUP BY pid", [f"{p}v"]),
        f"{p}plan": (f"""SELECT m.* FROM {p}m m LEFT JOIN {p}al a ON m.pid = a.pid
WHERE m.versions = 'all' OR len(list_filter(m.segs, lambda x: NOT list_contains(coalesce(a.allow, []::VARCHAR[]), x))) = 0""",
                     [f"{p}m", f"{p}al"]),
        f"{p}planned": (f"""SELECT id, pid, product_title, root_path, url, path, segs, fp AS pord, fu AS uord FROM (
  SELECT *, substring(sha1(url), 1, 16) AS id,
    row_number() OVER (PARTITION BY substring(sha1(url), 1, 16) ORDER BY pord DESC, uord DESC) AS lastrk,
    first_value(pord) OVER (PARTITION BY substring(sha1(url), 1, 16) ORDER BY pord, uord) AS fp,
    first_value(uord) OVER (PARTITION BY substring(sha1(url), 1, 16) ORDER BY pord, uord) AS fu
  FROM {p}plan) q WHERE lastrk = 1""", [f"{p}plan"]),
    }


def _topics_sql(planned: str):
    """Topic records of the run whose deduplicated plan is ``planned``."""
    return (f"""SELECT pl.id, pl.url, pa.title, pl.pid AS product, pl.product_title,
  coalesce(pl.segs[1], pa.meta_version) AS version, pa.meta_type AS content_type,
  coalesce(cr.crumbs[1], '') AS section,
  coalesce(list_filter(cr.crumbs, lambda x: NOT regexp_matches(x, '^[0-9]+[.][0-9]+([.][0-9]+)?$'))[1], '') AS section_name,
  cr.crumbs AS breadcrumb, pa.meta_modified AS last_modified,
  pl.id || '.html' AS file, pa.text, pa.body_html, pa.content_node, pl.pord, pl.uord
FROM {planned} pl
JOIN doc_urls d ON d.doc_url = pl.url
JOIN parsed pa ON pa.page_id = d.page_id AND pa.is_html
JOIN (SELECT id, CASE WHEN len(rs) > 0 AND list_slice(p, 1, len(rs)) = rs THEN list_slice(p, len(rs) + 1, len(p)) ELSE p END AS crumbs
      FROM (SELECT id, string_split(root_path, '/') AS rs,
              CASE WHEN len(p0) > 0 AND p0[1] = 'en' THEN list_slice(p0, 2, len(p0)) ELSE p0 END AS p
            FROM (SELECT id, root_path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p0 FROM {planned}) a) b) cr
  ON cr.id = pl.id""", [planned, "doc_urls", "parsed"])


CTES: dict[str, tuple[str, list[str]]] = {
    "doc_urls": (f"""SELECT page_id, concat('{DOC_HOST}/en/', root, '/',
  CASE WHEN page_id < 6 THEN '' ELSE concat(
    CASE WHEN page_id % 17 = 0 THEN 'ja/' ELSE '' END,
    CASE WHEN ver = '' THEN '' ELSE concat(ver, '/') END,
    CASE WHEN page_id % 23 = 0 THEN '9.4/' ELSE '' END,
    CASE WHEN page_id % 19 = 0 THEN 'legacy-cloud' ELSE section END,
    '/t', CAST(page_id AS VARCHAR)) END) AS doc_url
FROM (SELECT page_id,
  CASE page_id % 6 WHEN 0 THEN 'core' WHEN 1 THEN 'cloud' WHEN 2 THEN 'suite-8'
    WHEN 3 THEN 'ops' WHEN 4 THEN 'flow/onsite' ELSE 'core-extra' END AS root,
  CASE (page_id // 6) % 7 WHEN 0 THEN '9.3' WHEN 1 THEN '9.4' WHEN 2 THEN '10.0'
    WHEN 3 THEN '9.4.2' WHEN 4 THEN '10.0.1' WHEN 5 THEN '9.10' ELSE '' END AS ver,
  CASE (page_id // 42) % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'search'
    WHEN 2 THEN 'install' ELSE 'release-notes' END AS section
  FROM pages) x""", []),
    "catalog": (_catalog_values(CATALOG_RAW), []),
    "catalog_prev": (_catalog_values(CATALOG_RAW_PREVIOUS), []),
    "u": (f"""SELECT doc_url AS url, page_id AS uord,
  regexp_replace(regexp_extract(doc_url, '{PATH_RE}', 1), ';[^/]*$', '') AS path FROM doc_urls""", ["doc_urls"]),
    **_plan("catalog", ""),
    **_plan("catalog_prev", "prev_"),
    # page source as served, and without what the parser removes
    "rich": (f"SELECT page_id, {RICH_HTML} AS html, {CONTENT_TYPE} AS content_type FROM pages", []),
    # page parse, regular-expression form
    "px": (f"""SELECT page_id, html, contains(content_type, 'text/html') AS is_html,
  regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS art,
  regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)</(body|html)>.*$', '') AS bod,
  regexp_matches(html, '<title>') AS has_title,
  regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title_src,
  regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1_src
FROM (SELECT page_id, replace(html, '{SIDEBAR}', '') AS html, content_type FROM rich) r""", ["rich"]),
    "pp": (f"""SELECT page_id, html, is_html, art, bod, title_src, has_title, h1_src,
  {_pieces('art')} AS art_p, {_pieces('bod')} AS bod_p FROM px""", ["px"]),
    "parsed": (f"""SELECT page_id, is_html, {META_VERSION} AS meta_version, {META_TYPE} AS meta_type,
  {META_MODIFIED} AS meta_modified,
  CASE WHEN has_title AND title_src <> '' THEN
    {_strip("regexp_replace(string_split_regex(" + _strip(_dec('title_src')) + ", '\\s*\\|\\s*')[1], '\\s*\\(last updated.*?\\)\\s*$', '')")}
  ELSE coalesce(nullif(array_to_string(list_filter(list_transform(string_split(regexp_replace(h1_src, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: {_strip(_dec('x'))}), lambda x: x <> ''), ''), ''), 'Untitled') END AS title,
  {_dec('title_src')} AS title_raw,
  CASE WHEN length(array_to_string(art_p, '')) + 9 > 150 THEN 'article' ELSE 'body' END AS content_node,
  CASE WHEN length(array_to_string(art_p, '')) + 9 > 150 THEN array_to_string(art_p, ' ')
       ELSE array_to_string(bod_p, ' ') END AS text,
  CASE WHEN length(array_to_string(art_p, '')) + 9 > 150 THEN art
       ELSE regexp_replace(bod, '{STRIP_BLOCKS}', '', 'g') END AS body_html
FROM pp""", ["pp"]),
    "topics": _topics_sql("planned"),
    "prev_topics": _topics_sql("prev_planned"),
    "nav": ("""SELECT product_title, coalesce(nullif(version, ''), '—') AS version, title, file, section, pord, uord
FROM topics""", ["topics"]),
    "topics_fx": ("""SELECT page_id, substring(sha1(doc_url), 1, 16) AS id, doc_url AS url,
  CASE page_id % 4 WHEN 0 THEN 'Core' WHEN 1 THEN 'Cloud' WHEN 2 THEN '' ELSE NULL END AS product_title,
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'task' WHEN 2 THEN 'reference' WHEN 3 THEN 'task' ELSE NULL END AS content_type,
  CASE (page_id // 6) % 7 WHEN 0 THEN '9.3' WHEN 1 THEN '9.4' WHEN 2 THEN '10.0'
    WHEN 3 THEN '9.4.2' WHEN 4 THEN '10.0.1' WHEN 5 THEN '9.10' ELSE '' END AS version,
  concat('2024-', lpad(CAST(1 + page_id % 12 AS VARCHAR), 2, '0'), '-',
    lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0'), 'T00:00:00',
    CASE WHEN page_id % 5 = 0 THEN 'Z' ELSE '.000Z' END) AS last_modified
FROM doc_urls""", ["doc_urls"]),
    "fx_norm": ("""SELECT page_id, id, url,
  coalesce(nullif(product_title, ''), 'Other') AS category,
  coalesce(nullif(product_title, ''), 'Other') AS product_title,
  coalesce(nullif(content_type, ''), 'Other') AS content_type,
  coalesce(nullif(version, ''), '—') AS version, last_modified
FROM topics_fx""", ["topics_fx"]),
    "doc_links": ("""SELECT s.page_id AS src_id, s.doc_url, k.k AS pos,
  CASE k.k WHEN 0 THEN t.doc_url
    WHEN 1 THEN concat(t.doc_url, '#s', CAST(s.page_id AS VARCHAR))
    WHEN 2 THEN substring(t.doc_url, 25) WHEN 3 THEN '#top'
    ELSE 'https://other.example.org/x' END AS href
FROM doc_urls s
CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) v(k)) k
CROSS JOIN (SELECT count(*) AS n FROM pages) c
JOIN doc_urls t ON t.page_id = (s.page_id * 7 + 3) % c.n""", ["doc_urls"]),
}


def _order(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen:
            return
        for d in CTES[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(body: str, *ctes: str) -> str:
    if not ctes:
        return body
    parts = [f"{n} AS (\n{CTES[n][0]}\n)" for n in _order(ctes)]
    return "WITH " + ",\n".join(parts) + "\n" + body
