"""SQL snippets for the oracle: the same semantics, written independently for DuckDB."""

from __future__ import annotations

from ..functions.filters import ASSET_EXTENSIONS, DEFAULT_EXCLUDES, NOISE_PARTS
from ..functions.platforms import NOISE
from .derived import for_oracle

CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}]"
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def parts(col: str) -> str:
    """Struct s(cheme), n(etloc), p(ath), q(uery), f(ragment)."""
    return f"regexp_extract(trim({col}), '{_URI}', ['s', 'n', 'p', 'q', 'f'])"


def canonical(u: str) -> str:
    """Canonical URL from a parts struct column."""
    host = (f"CASE WHEN lower({u}.s) = 'http' AND lower({u}.n) LIKE '%:80' THEN left(lower({u}.n), -3) "
            f"WHEN lower({u}.s) = 'https' AND lower({u}.n) LIKE '%:443' THEN left(lower({u}.n), -4) ELSE lower({u}.n) END")
    path = f"coalesce(nullif(rtrim(regexp_replace({u}.p, '/index\\.(html?|md)$', '/'), '/'), ''), '/')"
    query = (f"coalesce('?' || nullif(array_to_string(list_filter(string_split({u}.q, '&'), "
             f"lambda kv: regexp_matches(kv, '^(hl|lang|version)=.')), '&'), ''), '')")
    return (f"CASE WHEN lower({u}.s) IN ('http', 'https') AND {u}.n <> '' "
            f"THEN lower({u}.s) || '://' || {host} || {path} || {query} END")


def with_canonical(source: str, col: str = "url", out: str = "canonical") -> str:
    return f"(SELECT * EXCLUDE (_u), {canonical('_u')} AS {out} FROM (SELECT *, {parts(col)} AS _u FROM {source}))"


def resolved(b: str, h: str, base: str, href: str) -> str:
    """Absolute URL from the parts of base and href."""
    tail = (f"CASE WHEN {h}.q <> '' THEN '?' || {h}.q ELSE '' END "
            f"|| CASE WHEN {h}.f <> '' THEN '#' || {h}.f ELSE '' END")
    merged = (f"CASE WHEN {h}.p LIKE '/%' THEN {h}.p ELSE "
              f"regexp_replace(regexp_replace({b}.p, '[^/]*$', '') || {h}.p, '/{{2,}}', '/', 'g') END")
    folded = (f"list_reduce(list_transform(string_split({merged}, '/'), lambda s: [s]), lambda done, s: "
              f"CASE WHEN s = ['..'] THEN done[:len(done) - 1] WHEN s = ['.'] THEN done ELSE done || s END)")
    path = (f"array_to_string({folded} || CASE WHEN string_split({h}.p, '/')[-1] IN ('.', '..') THEN [''] "
            f"ELSE [] END, '/')")
    return (f"CASE WHEN {href} = '' THEN {base} WHEN {h}.s <> '' AND lower({h}.s) <> {b}.s THEN {href} "
            f"WHEN {h}.n <> '' THEN {b}.s || '://' || {h}.n || {h}.p || {tail} "
            f"WHEN {h}.p = '' THEN {b}.s || '://' || {b}.n || {b}.p || CASE WHEN {h}.q <> '' THEN '?' || {h}.q "
            f"WHEN {b}.q <> '' THEN '?' || {b}.q ELSE '' END || CASE WHEN {h}.f <> '' THEN '#' || {h}.f ELSE '' END "
            f"ELSE {b}.s || '://' || {b}.n || '/' || ltrim({path}, '/') || {tail} END")


def with_resolved(source: str, base: str = "src_url", href: str = "href") -> str:
    """Adds abs_url and dst_url."""
    absolute = (f"(SELECT * EXCLUDE (_b, _h), {resolved('_b', '_h', base, href)} AS abs_url "
                f"FROM (SELECT *, {parts(base)} AS _b, {parts(href)} AS _h FROM {source}))")
    return with_canonical(absolute, "abs_url", "dst_url")


def anchors(source: str, keep: str = "url AS src_url") -> str:
    """``keep`` columns, pos and href of every anchor of regular markup."""
    return (f"(SELECT {keep}, generate_subscripts(_l, 1) - 1 AS pos, unnest(_l) AS href FROM "
            f"(SELECT *, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS _l FROM {source}))")


def path_of(col: str) -> str:
    return f"{parts(col)}.p"


def host_of(col: str) -> str:
    return f"lower({parts(col)}.n)"


def ext_of(path: str) -> str:
    return f"lower(regexp_extract({path}, '\\.[^./]*$'))"


def any_of(path: str, words) -> str:
    return "(" + " OR ".join(f"instr({path}, '{w}') > 0" for w in words) + ")"


def text_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def asset(path: str) -> str:
    return f"{ext_of(path)} IN {text_list(ASSET_EXTENSIONS)}"


def noise(path: str) -> str:
    return any_of(path, NOISE_PARTS)


def platform_noise(adapter: str, path: str) -> str:
    return "(CASE " + adapter + " " + " ".join(
        f"WHEN '{name}' THEN {any_of(path, words)}" for name, words in NOISE.items()) + " ELSE false END)"


def excluded(path: str) -> str:
    return f"{path} IN {text_list(DEFAULT_EXCLUDES)}"


def kept(path: str, adapter: str) -> str:
    """The composite check of a site without include or exclude rules."""
    return f"NOT ({asset(path)} OR {platform_noise(adapter, path)} OR {noise(path)} OR {excluded(path)})"


def tokens(text: str) -> str:
    cjk = f"(length({text}) - length(regexp_replace({text}, '{CJK}', '', 'g')))"
    return f"({cjk} + (length({text}) - {cjk} + 3) // 4)"


def derived(text: str) -> str:
    return for_oracle(text)


def _cost(text: str) -> str:
    """Tokens of text without CJK signs; the driver's documents have none."""
    return f"((length({text}) + 3) // 4)"


_BLANKS = "' ' || chr(10)"
_GAP = "chr(10) || chr(10)"


def _greedy(name: str, source: str, keys: str, at: str, unit: str, weight: str, limit: int, total: str) -> str:
    """Recursive CTE that numbers greedy groups of ordered units; ``total`` is the cost of a summed weight."""
    return f"""{name} AS (SELECT {keys}, {at}, 1 AS grp, {weight.format(unit)} AS n FROM {source} WHERE {at} = 1
  UNION ALL SELECT {keys}, u.{at}, CASE WHEN {total.format(f"(n + {weight.format('u.' + unit)})")} > {limit} THEN grp + 1 ELSE grp END,
    CASE WHEN {total.format(f"(n + {weight.format('u.' + unit)})")} > {limit} THEN {weight.format('u.' + unit)} ELSE n + {weight.format('u.' + unit)} END
  FROM (SELECT {keys}, {at} + 1 AS {at}, grp, n FROM {name}) JOIN {source} u USING ({keys}, {at}))"""


def cut_ctes(limit: int) -> str:
    """CTEs from ``big(doc, block, text)``, texts over the limit, to ``cut_pieces(doc, block, pieces)``."""
    return rf"""
para AS MATERIALIZED (SELECT doc, block, generate_subscripts(l, 1) AS p, unnest(l) AS para FROM (SELECT *, list_filter(list_transform(
    regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS l FROM big)),
sent AS MATERIALIZED (SELECT doc, block, p, generate_subscripts(l, 1) AS s, unnest(l) AS sent FROM (SELECT *, list_filter(string_split(
    regexp_replace(para, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_BLANKS}) <> '') AS l FROM para WHERE {_cost('para')} > {limit})),
{_greedy('runs', 'sent', 'doc, block, p', 's', 'sent', 'length({})', limit, '(({} + 3) // 4)')},
run_text AS MATERIALIZED (SELECT *, run = max(run) OVER (PARTITION BY doc, block, p) AND {_cost('text')} > {limit} AS sliced FROM (
    SELECT doc, block, p, grp AS run, string_agg(sent, '' ORDER BY s) AS text FROM runs JOIN sent USING (doc, block, p, s)
    GROUP BY doc, block, p, grp)),
unit AS MATERIALIZED (SELECT doc, block, p, run, generate_subscripts(l, 1) AS u, unnest(l) AS unit FROM
    (SELECT *, regexp_extract_all(text, '[^\s]+|\s+') AS l FROM run_text WHERE sliced)),
{_greedy('slices', 'unit', 'doc, block, p, run', 'u', 'unit', _cost('{}'), limit, '{}')},
para_pieces AS MATERIALIZED (SELECT doc, block, p, list(text ORDER BY run, slice) AS pieces FROM (
    SELECT doc, block, p, run, 0 AS slice, trim(text, {_BLANKS}) AS text FROM run_text WHERE NOT sliced
    UNION ALL SELECT doc, block, p, run, grp, string_agg(unit, '' ORDER BY u) FROM slices JOIN unit USING (doc, block, p, run, u) GROUP BY doc, block, p, run, grp)
    GROUP BY doc, block, p),
paras AS MATERIALIZED (SELECT * FROM para LEFT JOIN para_pieces USING (doc, block, p)),
cut AS (SELECT doc, block, 0 AS p, '' AS held, []::VARCHAR[] AS done FROM big
  UNION ALL SELECT doc, block, p, CASE WHEN x.pieces IS NOT NULL THEN '' WHEN {_cost(f"(held || {_GAP} || x.para)")} > {limit} THEN x.para
      ELSE trim(held || {_GAP} || x.para, {_BLANKS}) END,
    CASE WHEN x.pieces IS NOT NULL THEN done || CASE WHEN held <> '' THEN [held] ELSE [] END || x.pieces
      WHEN {_cost(f"(held || {_GAP} || x.para)")} > {limit} THEN done || [held] ELSE done END
  FROM (SELECT doc, block, p + 1 AS p, held, done FROM cut) JOIN paras x USING (doc, block, p)),
cut_pieces AS MATERIALIZED (SELECT doc, block, done || CASE WHEN held <> '' THEN [held] ELSE [] END AS pieces FROM cut
  QUALIFY row_number() OVER (PARTITION BY doc, block ORDER BY p DESC) = 1)"""


def chunks(blocks: str, max_tokens: int, overlap: int) -> str:
    """``(doc, seq, path, tokens, text)`` from ``blocks(doc, block, path, text)``, numbered from 0."""
    def tail(text: str) -> str:
        return f"array_to_string(regexp_extract_all({text}, '[A-Za-z0-9_]+|.')[-{overlap}:], '')"

    def led(lead: str, text: str) -> str:
        return f"CASE WHEN {lead} <> '' THEN {lead} || {_GAP} || {text} ELSE {text} END"

    return rf"""
WITH RECURSIVE blk AS MATERIALIZED (SELECT * FROM {blocks}),
big AS MATERIALIZED (SELECT doc, block, text FROM blk WHERE {_cost('text')} > {max_tokens}),{cut_ctes(max_tokens - overlap)},
led AS MATERIALIZED (SELECT doc, block, generate_subscripts(pieces, 1) AS k, unnest(pieces) AS piece, len(pieces) AS n, unnest([''] || pieces[:-2]) AS prior FROM cut_pieces),
rest AS MATERIALIZED (SELECT doc, block, list({led(tail('prior'), 'piece')} ORDER BY k) FILTER (k > 1) AS later, min(piece) FILTER (k = 1) AS first,
    {tail('max(piece) FILTER (k = n)')} AS last_tail FROM led GROUP BY doc, block),
item AS MATERIALIZED (SELECT b.*, first, later, last_tail, {_cost('b.text')} > {max_tokens} AS oversized FROM blk b LEFT JOIN rest USING (doc, block)),
pack AS (SELECT doc, -1 AS block, '' AS held, []::VARCHAR[] AS path, '' AS tail, []::STRUCT(path VARCHAR[], tokens BIGINT, text VARCHAR)[] AS new
    FROM (SELECT DISTINCT doc FROM blk)
  UNION ALL SELECT doc, block, CASE WHEN oversized THEN '' WHEN flush THEN {led('tail', 'text')} ELSE trim(held || {_GAP} || text, {_BLANKS}) END,
    path, CASE WHEN oversized THEN last_tail ELSE tail END,
    CASE WHEN flush THEN [{{path: old, tokens: {_cost('held')}, text: trim(held, {_BLANKS})}}] ELSE [] END
    || CASE WHEN oversized THEN list_transform([{led('tail', 'first')}] || coalesce(later, []), lambda x: {{path: path, tokens: {_cost('x')}, text: x}}) ELSE [] END
  FROM (SELECT *, CASE WHEN flush THEN {tail('held')} ELSE before END AS tail FROM (
    SELECT x.*, held, pack.path AS old, pack.tail AS before,
      held <> '' AND (oversized OR {_cost(f"(held || {_GAP} || x.text)")} > {max_tokens}) AS flush
    FROM pack JOIN item x ON x.doc = pack.doc AND x.block = pack.block + 1))),
emitted AS (SELECT doc, block, new FROM pack UNION ALL SELECT doc, block + 1, CASE WHEN held <> '' THEN
    [{{path: path, tokens: {_cost('held')}, text: trim(held, {_BLANKS})}}] ELSE [] END FROM pack
  QUALIFY row_number() OVER (PARTITION BY doc ORDER BY block DESC) = 1)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY block, k) - 1 AS seq, c.path AS path, c.tokens AS tokens, c.text AS text
FROM (SELECT doc, block, generate_subscripts(new, 1) AS k, unnest(new) AS c FROM emitted)"""
