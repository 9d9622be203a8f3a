"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from palimpsest.plans.queries import AS_OF, NAMESPACE, ORDERED

ORACLES: dict[str, str] = {}


def _lines(table: str, keys: str, name: str = "lines") -> str:
    return f"{name} AS (SELECT {keys}, unnest(range(len(l))) AS line_ix, unnest(l) AS line FROM (SELECT {keys}, string_split(text, chr(10)) AS l FROM {table}))"


def _grams(source: str, keys: str, name: str, text: str = "line", inner: bool = False) -> str:
    """A row per key and gram, with its count n."""
    n = f"(octet_length(encode({text})) + 3)"
    lo, hi = ("0", n) if not inner else (f"least(({n} - 1) // 2, 3)", f"{n} - least(({n} - 1) // 2, 3)")
    return f"{name} AS (SELECT {keys}, gram, CAST(count(*) AS BIGINT) AS n FROM (SELECT {keys}, unnest(list_transform(range({lo}, {hi}), lambda i: substr(h, CAST(1 + 2 * i AS BIGINT), 8))) AS gram FROM (SELECT *, '000000' || hex(encode({text})) || '000000' AS h FROM {source})) GROUP BY ALL)"


DOC, ITEM = _lines("documents", "doc_id"), _lines("benchmark", "item_id", "items")
TALK = _lines("conversations", "conv_id, turn", "talk")
EV = "ev AS (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_type = 'error' AS is_removed, (epoch_us(ts) // 1000) AS commit_ts, event_id AS seq FROM events)"
EDGES = """pairs AS (
  SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS child_id FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
edges AS (SELECT parent_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY child_id) - 1 AS INT) AS child_index, child_id FROM pairs)"""
TURNS = "turns AS (SELECT 'v' || conv_id AS conv, 't' || conv_id || '.' || turn AS turn_id, conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ix FROM conversations)"
TLINES = "tl AS (SELECT conv, turn_id, turn, ix, role, unnest(range(len(l))) AS line_ix, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM turns)), tlines AS (SELECT *, 'l' || substr(turn_id, 2) || '.' || line_ix AS line_id FROM tl)"

ORACLES["q_split_lines"] = f"WITH {DOC} SELECT doc_id, line_ix, line FROM lines"
ORACLES["q_blank_lines"] = f"WITH {DOC} SELECT doc_id, count(*) FILTER (WHERE NOT regexp_matches(line, '\\S')) AS n_blank, count(*) AS n_lines FROM lines GROUP BY doc_id"
ORACLES["q_grams"] = f"WITH {DOC}, {_grams('lines', 'doc_id, line_ix', 'g')} SELECT gram, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_blocks FROM g GROUP BY gram"
ORACLES["q_gram_count"] = f"WITH {DOC} SELECT doc_id, line_ix, CAST(octet_length(encode(line)) + 3 AS BIGINT) AS n_grams FROM lines"
ORACLES["q_chain_grams"] = f"WITH c AS (SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN '' ELSE text END, '' ORDER BY turn) AS line FROM conversations GROUP BY conv_id), {_grams('c', 'conv_id', 'g')} SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_grams, count(*) AS n_distinct FROM g GROUP BY conv_id"
_CHANGED = f"{ITEM}, {_grams('items', 'item_id, line_ix', 'b')}, after AS (SELECT item_id, line_ix, replace(line, 'e', '3') AS line FROM items), {_grams('after', 'item_id, line_ix', 'a')}"
ORACLES["q_gram_changes"] = f"WITH {_CHANGED} SELECT item_id, line_ix, gram, CAST(coalesce(a.n, 0) AS BIGINT) AS n FROM b FULL JOIN a USING (item_id, line_ix, gram) WHERE a.n IS DISTINCT FROM b.n"
ORACLES["q_gram_upsert"] = f"WITH {_CHANGED} SELECT item_id, line_ix, gram, n FROM a"
_SEARCH = f"""{ITEM}, {DOC}, {_grams('items', 'item_id, line_ix', 't', inner=True)}, {_grams('lines', 'doc_id, line_ix', 'g')},
s AS (SELECT item_id, line_ix, sum(n) AS s FROM t GROUP BY ALL HAVING bool_or(gram <> '00000000')),
x AS (SELECT t.item_id, t.line_ix AS term_ix, g.doc_id, g.line_ix, sum(least(t.n, g.n)) AS x FROM t JOIN g USING (gram) GROUP BY ALL),
found AS (SELECT x.item_id, x.term_ix, x.doc_id, x.line_ix, CAST(255 * x.x // s.s AS INT) AS i FROM x JOIN s ON s.item_id = x.item_id AND s.line_ix = x.term_ix WHERE 255 * x.x // s.s >= 77)"""
ORACLES["q_search"] = f"WITH {_SEARCH} SELECT *, CAST(i AS DOUBLE) / 255 AS score FROM found"
ORACLES["q_search_topk"] = f"WITH {_SEARCH} SELECT item_id, term_ix, CAST(rank AS INT) AS rank, doc_id, line_ix, i FROM (SELECT *, row_number() OVER (PARTITION BY item_id, term_ix ORDER BY i DESC, doc_id, line_ix) AS rank FROM found) WHERE rank <= 5"
_HALF = "least(255 * s // greatest(s, m), 255 * m // greatest(s, m)) > 0 AND 2 * (255 * x // greatest(s, m)) > least(255 * s // greatest(s, m), 255 * m // greatest(s, m))"
_ABI = "CAST(255 * s // greatest(s, m) AS INT) AS a, CAST(255 * m // greatest(s, m) AS INT) AS b, CAST(255 * x // greatest(s, m) AS INT) AS i"
_OVER = f"""{TALK}, {_grams('talk', 'conv_id, turn, line_ix', 'g')},
p AS (SELECT u.conv_id AS src_conv, u.turn AS src_turn, u.line_ix AS src_line, v.conv_id AS conv, v.turn AS turn, v.line_ix AS line, sum(least(u.n, v.n)) AS x FROM g u JOIN g v ON u.gram = v.gram AND (u.conv_id, u.turn, u.line_ix) <> (v.conv_id, v.turn, v.line_ix) GROUP BY ALL),
z AS (SELECT p.*, octet_length(encode(a.line)) + 3 AS s, octet_length(encode(b.line)) + 3 AS m FROM p JOIN talk a ON (a.conv_id, a.turn, a.line_ix) = (src_conv, src_turn, src_line) JOIN talk b ON (b.conv_id, b.turn, b.line_ix) = (p.conv, p.turn, p.line))"""
ORACLES["q_overlaps"] = f"WITH {_OVER} SELECT src_conv, src_turn, src_line, conv, turn, line, {_ABI} FROM z WHERE {_HALF}"
ORACLES["q_overlap_topk"] = f"WITH {_OVER}, found AS (SELECT src_conv, src_turn, src_line, conv, turn, line, {_ABI} FROM z WHERE {_HALF}) SELECT src_conv, src_turn, src_line, conv, turn, line, a, b, i, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src_conv, src_turn, src_line ORDER BY i DESC, a DESC, b DESC, conv, turn, line) AS rank FROM found) WHERE rank <= 3"
ORACLES["q_overlap_reverse"] = ORACLES["q_overlaps"]
ORACLES["q_overlap_cross"] = f"""WITH {ITEM}, {DOC}, {_grams('items', 'item_id, line_ix', 't')}, {_grams('lines', 'doc_id, line_ix', 'g')},
p AS (SELECT t.item_id, t.line_ix AS item_line, g.doc_id, g.line_ix, sum(least(t.n, g.n)) AS x FROM t JOIN g USING (gram) GROUP BY ALL),
z AS (SELECT p.*, octet_length(encode(a.line)) + 3 AS s, octet_length(encode(b.line)) + 3 AS m FROM p JOIN items a ON a.item_id = p.item_id AND a.line_ix = p.item_line JOIN lines b ON b.doc_id = p.doc_id AND b.line_ix = p.line_ix)
SELECT item_id, item_line, doc_id, line_ix, {_ABI} FROM z WHERE {_HALF}"""



def _state(name: str, text: str) -> str:
    """The overlaps of one state of the benchmark's lines, as `name`."""
    return f"""{name}_l AS (SELECT item_id, line_ix, {text} AS line FROM items), {_grams(f'{name}_l', 'item_id, line_ix', f'{name}_g')},
{name}_p AS (SELECT u.item_id AS src_item, u.line_ix AS src_line, v.item_id, v.line_ix, sum(least(u.n, v.n)) AS x FROM {name}_g u JOIN {name}_g v ON u.gram = v.gram AND (u.item_id, u.line_ix) <> (v.item_id, v.line_ix) GROUP BY ALL),
{name}_z AS (SELECT p.*, octet_length(encode(a.line)) + 3 AS s, octet_length(encode(b.line)) + 3 AS m FROM {name}_p p JOIN {name}_l a ON a.item_id = src_item AND a.line_ix = src_line JOIN {name}_l b ON b.item_id = p.item_id AND b.line_ix = p.line_ix),
{name} AS (SELECT src_item, src_line, item_id, line_ix, {_ABI} FROM {name}_z WHERE {_HALF})"""


ORACLES["q_overlap_changes"] = f"""WITH {ITEM}, {_state('was', 'line')}, {_state('now', "CASE WHEN item_id % 3 = 0 THEN replace(line, 'e', '3') ELSE line END")}
SELECT src_item, src_line, item_id, line_ix, coalesce(now.a, was.a) AS a, coalesce(now.b, was.b) AS b, coalesce(now.i, was.i) AS i, CASE WHEN was.i IS NULL THEN 'added' WHEN now.i IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM was FULL JOIN now USING (src_item, src_line, item_id, line_ix) WHERE (was.a, was.b, was.i) IS DISTINCT FROM (now.a, now.b, now.i)"""

_LAST = "arg_max(struct_pack(value := value, is_removed := is_removed, commit_ts := commit_ts, seq := seq), seq)"


def _latest(source: str, where: str = "true") -> str:
    return f"last AS (SELECT key, {_LAST} AS v FROM {source} WHERE {where} GROUP BY key)"


ORACLES["q_kv_latest"] = f"WITH {EV}, {_latest('ev')} SELECT key, v.value AS value, v.commit_ts AS commit_ts FROM last WHERE NOT v.is_removed"
ORACLES["q_stream_latest"] = ORACLES["q_kv_latest"]
ORACLES["q_kv_unremoved"] = f"WITH {EV}, {_latest('ev', 'NOT is_removed')} SELECT key, v.value AS value, v.commit_ts AS commit_ts FROM last"
ORACLES["q_kv_versions"] = f"WITH {EV} SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS version_no, seq, is_removed FROM ev"
ORACLES["q_kv_get_version"] = f"WITH {EV} SELECT key, CASE WHEN NOT is_removed THEN value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM ev) WHERE n = 3"
ORACLES["q_kv_as_of"] = f"WITH {EV}, {_latest('ev', 'commit_ts <= (SELECT (min(commit_ts) + max(commit_ts)) // 2 FROM ev)')} SELECT key, v.value AS value, v.commit_ts AS commit_ts FROM last WHERE NOT v.is_removed"
ORACLES["q_kv_before_seq"] = f"WITH {EV}, {_latest('ev', 'seq < (SELECT (max(seq) + 1) // 2 FROM ev)')} SELECT key, v.value AS value, v.seq AS seq FROM last WHERE NOT v.is_removed"
ORACLES["q_kv_keys"] = f"WITH {EV}, {_latest('ev')} SELECT key FROM last WHERE NOT v.is_removed"
ORACLES["q_kv_last_updated"] = f"WITH {EV} SELECT max(commit_ts) AS last_updated FROM ev"
ORACLES["q_kv_latest_version"] = f"WITH {EV} SELECT key, max(commit_ts) AS ts FROM ev GROUP BY key"
ORACLES["q_kv_merge"] = f"WITH {EV}, {_latest('ev')} SELECT key, CASE WHEN NOT v.is_removed THEN v.value END AS value, v.is_removed AS is_removed, v.seq AS seq FROM last"
ORACLES["q_kv_stage"] = f"WITH {EV}, {_latest('ev')} SELECT key, upper(v.value) AS value, v.is_removed AS is_removed, CAST(2000000000000 AS BIGINT) AS commit_ts, CAST(1000000000 + v.seq AS BIGINT) AS seq FROM last"
ORACLES["q_kv_monotonic"] = f"WITH {EV}, s AS (SELECT seq, commit_ts - (seq * 7919 % 100) * 60000 AS commit_ts FROM ev) SELECT seq, commit_ts, max(commit_ts) OVER (ORDER BY seq) AS monotonic_ts FROM s"
ORACLES["q_kv_size"] = f"WITH {EV} SELECT count(*) AS n_entries, CAST(sum(octet_length(encode(value))) AS BIGINT) AS n_bytes FROM ev"
ORACLES["q_tx_conflict"] = f"WITH {EV}, w AS (SELECT key, max(seq) AS newest FROM ev GROUP BY key) SELECT ev.seq // 2 AS tx_id, bool_or(newest >= ev.seq + 100) AS conflict FROM ev JOIN w USING (key) GROUP BY 1"

# CRC-32 by its table, a byte at a time.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"
ORACLES["q_tx_crc"] = f"""WITH {EV}, tx AS (SELECT seq // 10 AS tx_id, string_agg(hex(encode(value)), '' ORDER BY seq) AS h FROM ev GROUP BY 1),
bytes AS (SELECT tx_id, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, CAST(1 + 2 * i AS BIGINT), 2) AS BIGINT)) AS b FROM tx)
SELECT tx_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS crc FROM bytes, {_CRC_TABLE}"""

ORACLES["q_parents"] = f"WITH {EDGES} SELECT child_id, count(*) AS n_parents, count(DISTINCT parent_id) AS n_distinct_parents FROM edges GROUP BY child_id"
ORACLES["q_descendants"] = f"WITH RECURSIVE {EDGES}, d AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT d.root, e.child_id, d.depth + 1 FROM d JOIN edges e ON e.parent_id = d.node) SELECT root, node, CAST(min(depth) AS INT) AS depth FROM d GROUP BY root, node"
ORACLES["q_descendants_until_links"] = f"WITH {TURNS}, {TLINES} SELECT DISTINCT conv AS root, conv AS node FROM turns UNION ALL SELECT conv, turn_id FROM turns UNION ALL SELECT conv, line_id FROM tlines WHERE role = 'user'"
ORACLES["q_ancestor_path"] = "SELECT 'o' || o_orderkey AS node, CAST(1 AS INT) AS depth, 'c' || o_custkey AS ancestor FROM orders UNION ALL SELECT 'o' || o_orderkey, 2, 'n' || c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'o' || o_orderkey, 3, 'r' || n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
ORACLES["q_ancestor_path_until_link"] = f"WITH {TURNS}, {TLINES} SELECT line_id AS node, CAST(1 AS INT) AS depth, turn_id AS ancestor FROM tlines UNION ALL SELECT line_id, 2, conv FROM tlines WHERE role = 'user'"
ORACLES["q_is_span"] = f"WITH {TURNS}, {TLINES} SELECT DISTINCT conv AS id, true AS is_span FROM turns UNION ALL SELECT turn_id, role = 'user' FROM turns UNION ALL SELECT 'h' || turn_id, true FROM turns UNION ALL SELECT line_id, true FROM tlines"
ORACLES["q_is_link"] = f"WITH {TURNS}, {TLINES} SELECT conv AS parent_id, CAST(ix AS INT) AS child_index, turn_id AS child_id, role <> 'user' AS is_link FROM turns UNION ALL SELECT turn_id, 0, 'h' || turn_id, false FROM turns UNION ALL SELECT 'h' || turn_id, CAST(line_ix AS INT), line_id, false FROM tlines"
ORACLES["q_is_blank"] = f"WITH {TURNS}, {TLINES} SELECT line_id AS id, NOT regexp_matches(line, '\\S') AS is_blank FROM tlines UNION ALL SELECT turn_id, NOT bool_or(regexp_matches(line, '\\S')) FROM tlines GROUP BY turn_id UNION ALL SELECT conv, NOT bool_or(regexp_matches(line, '\\S')) FROM tlines GROUP BY conv"
ORACLES["q_is_cyclic"] = "WITH p AS (SELECT l_orderkey AS o, l_partkey AS p, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT o, p_name, count(*) AS n FROM p JOIN part ON p_partkey = p GROUP BY ALL), m AS (SELECT o, max(n) AS n FROM (SELECT o, n FROM p UNION ALL SELECT o, n FROM t) GROUP BY o) SELECT 'o' || o_orderkey AS root, coalesce(m.n > 1, false) AS revisits FROM orders LEFT JOIN m ON m.o = o_orderkey"
ORACLES["q_true_cycles"] = f"WITH {EDGES} SELECT DISTINCT parent_id AS root, false AS cyclic FROM edges UNION ALL SELECT 'k' || n_nationkey, true FROM nation"
ORACLES["q_shared"] = "WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, max(n) AS n FROM lineitem JOIN n USING (l_partkey) GROUP BY ALL) SELECT 'o' || o_orderkey AS root, coalesce(m.n > 1, false) AS shared FROM orders LEFT JOIN m ON l_orderkey = o_orderkey"
_LEAVES = f"WITH {TURNS}, {TLINES}, leaves AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn, line_ix) AS pos FROM tlines WHERE regexp_matches(line, '\\S')), spanned AS (SELECT conv, turn_id, min(pos) AS lo, max(pos) AS hi FROM leaves GROUP BY ALL)"
ORACLES["q_siblings_before"] = _LEAVES + " SELECT b.line_id AS id, a.line_id AS sibling FROM leaves a JOIN leaves b ON a.conv = b.conv AND a.pos = b.pos - 1 UNION ALL SELECT s.turn_id, a.line_id FROM spanned s JOIN leaves a ON a.conv = s.conv AND a.pos = s.lo - 1"
ORACLES["q_siblings_after"] = _LEAVES + " SELECT b.line_id AS id, a.line_id AS sibling FROM leaves a JOIN leaves b ON a.conv = b.conv AND a.pos = b.pos + 1 UNION ALL SELECT s.turn_id, a.line_id FROM spanned s JOIN leaves a ON a.conv = s.conv AND a.pos = s.hi + 1"
ORACLES["q_preview"] = f"WITH {TURNS}, {TLINES} SELECT conv AS root, CASE WHEN regexp_matches(line, '\\S') THEN 'Block' ELSE 'Empty' END AS outcome, CASE WHEN regexp_matches(line, '\\S') THEN line_id END AS block_id FROM tlines WHERE ix = 0 AND line_ix = 0"
ORACLES["q_preview_styles"] = f"""WITH {TURNS}, {TLINES}, f AS (SELECT turn_id, bool_or(regexp_matches(line, '\\S')) AS full_ FROM tlines GROUP BY turn_id)
SELECT turn_id AS root, CASE WHEN full_ THEN 'Block' ELSE 'Empty' END AS outcome, CASE WHEN full_ THEN 'h' || turn_id END AS block_id, CASE WHEN role = 'user' THEN '' ELSE 'Quote' END AS block_styles, CASE WHEN role = 'user' THEN 'Italic' ELSE '' END AS span_styles FROM turns JOIN f USING (turn_id)"""
ORACLES["q_preview_blocks"] = f"""WITH {TURNS}, f AS (SELECT conv, bool_or(regexp_matches(text, '\\S')) AS full_ FROM turns GROUP BY conv)
SELECT conv AS root, 'Block' AS outcome, conv AS block_id, CAST(ix AS INT) AS ix, text, CASE WHEN role = 'user' THEN 'Italic' ELSE '' END AS styles FROM turns JOIN f USING (conv) WHERE full_ UNION ALL SELECT conv, 'Empty', NULL, NULL, '', '' FROM f WHERE NOT full_"""
ORACLES["q_mismatches"] = f"WITH {TURNS}, {TLINES} SELECT turn_id AS id, 'Styled' AS kind, CAST(0 AS BIGINT) AS n_children FROM turns WHERE role = 'user' UNION ALL SELECT line_id, 'Text', 1 FROM tlines"
ORACLES["q_sections"] = f"WITH {EDGES}, n AS (SELECT child_id, count(*) AS n FROM edges GROUP BY ALL) SELECT parent_id AS root, child_index AS section_ix, CASE WHEN n > 1 THEN child_id END AS section_id, n > 1 AS has_multiple_parents FROM edges JOIN n USING (child_id) WHERE parent_id LIKE 'o%'"
ORACLES["q_subsections"] = f"WITH {TURNS}, {TLINES} SELECT conv AS root, CAST(ix AS INT) AS turn_ix, CAST(line_ix AS INT) AS line_ix, line_id AS id FROM tlines"
ORACLES["q_spans"] = f"WITH {TURNS} SELECT conv AS root, CAST(ix AS INT) AS ix, text, CASE WHEN role = 'user' THEN 'Italic' ELSE '' END AS styles FROM turns"
ORACLES["q_lineage"] = f"WITH {TURNS} SELECT turn_id AS id, CAST(0 AS INT) AS depth, turn_id AS ancestor FROM turns UNION ALL SELECT turn_id, 1, conv FROM turns WHERE role = 'user'"
ORACLES["q_parent_branches"] = f"WITH {TURNS} SELECT turn_id AS root, conv AS parent_id FROM turns WHERE role <> 'user'"

ORACLES["q_tile_branches"] = f"""WITH {DOC}, e AS (SELECT 'd' || doc_id AS root, line_ix, md5(line) AS id, line FROM lines),
nb AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY line_ix) AS pos FROM e WHERE regexp_matches(line, '\\S')),
cnt AS (SELECT id, count(*) AS n FROM e GROUP BY id),
near AS (SELECT b.id, a.id AS sibling, a.root, a.pos < b.pos AS is_before FROM nb a JOIN nb b ON a.root = b.root AND abs(a.pos - b.pos) = 1),
up AS (SELECT DISTINCT near.id, CASE WHEN n = 1 THEN root ELSE sibling END AS sibling, is_before FROM near JOIN cnt ON cnt.id = near.sibling)
SELECT DISTINCT root, e.id, sibling, is_before FROM e JOIN up USING (id) WHERE sibling <> root AND (root, sibling) NOT IN (SELECT root, id FROM e)"""

_LISTS = f"{DOC}, lists AS (SELECT CAST(doc_id AS VARCHAR) AS parent_id, CAST(line_ix AS INT) AS child_index, doc_id || '.' || line_ix AS child_id FROM lines)"
ORACLES["q_remove_reindex"] = f"WITH {_LISTS} SELECT parent_id, CAST(child_index - 1 AS INT) AS child_index, child_id FROM lists WHERE child_index > 0"
ORACLES["q_insert"] = f"WITH {_LISTS} SELECT parent_id, CAST(CASE WHEN child_index >= 1 THEN child_index + 1 ELSE 0 END AS INT) AS child_index, child_id FROM lists UNION ALL SELECT DISTINCT parent_id, 1, 'new' || parent_id FROM lists"
ORACLES["q_replace"] = f"WITH {_LISTS} SELECT parent_id, child_index, CASE WHEN child_index = 0 THEN 'new' || parent_id ELSE child_id END AS child_id FROM lists"
ORACLES["q_push"] = f"WITH {_LISTS} SELECT parent_id, child_index, child_id FROM lists UNION ALL SELECT parent_id, CAST(max(child_index) + 1 AS INT), 'new' || parent_id FROM lists GROUP BY parent_id"
ORACLES["q_orphans"] = "WITH gone AS (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') SELECT 'o' || o_orderkey AS id FROM gone UNION ALL SELECT 'p' || l_partkey FROM lineitem GROUP BY l_partkey HAVING bool_and(l_orderkey IN (SELECT o_orderkey FROM gone))"
ORACLES["q_export_since"] = f"SELECT 'o' || o_orderkey AS id, 'List' AS kind FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND (epoch_us(o_orderdate) // 1000) > {ORDERED} UNION ALL SELECT '00000000-0000-0000-0000-000000000000', 'List'"

ORACLES["q_export_edges"] = f"WITH {EDGES}, o AS (SELECT 'o' || o_orderkey AS id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND (epoch_us(o_orderdate) // 1000) > {ORDERED}) SELECT parent_id, child_index, child_id FROM edges JOIN o ON id = parent_id UNION ALL SELECT '00000000-0000-0000-0000-000000000000', 0, 'r1'"
ORACLES["q_restore"] = f"WITH {EDGES}, c AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'), lost AS (SELECT id FROM c UNION SELECT child_id FROM edges JOIN c ON id = parent_id) SELECT parent_id, child_index, child_id FROM edges JOIN lost ON id = parent_id"


def _word(hex_text: str, i: int) -> str:
    return f"CAST('0x' || substr({hex_text}, {1 + 8 * i}, 8) AS BIGINT)"


_XOR = " || ".join(f"lower(lpad(format('{{:x}}', xor({_word('h', i)}, {int(NAMESPACE.replace('-', '')[8 * i : 8 * i + 8], 16)})), 8, '0'))" for i in range(4))
_HYPHENS = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
ORACLES["q_import_xor"] = f"WITH m AS (SELECT doc_id, md5(text) AS h FROM documents), x AS (SELECT doc_id, h, {_XOR} AS y FROM m) SELECT doc_id, {_HYPHENS.format('h')} AS id, {_HYPHENS.format('y')} AS namespaced FROM x"
_MOVED = _HYPHENS.format(f"({_XOR})")
ORACLES["q_import_edges"] = f"""WITH l AS (SELECT md5(item_id || ':' || text) AS p, unnest(range(len(x))) AS child_index, unnest(x) AS line FROM (SELECT *, string_split(text, chr(10)) AS x FROM benchmark)),
e AS (SELECT p, CAST(child_index AS INT) AS child_index, md5(line) AS c FROM l)
SELECT {_HYPHENS.format('p')} AS parent_id, child_index, {_HYPHENS.format('c')} AS child_id FROM e
UNION ALL SELECT {_MOVED.replace("substr(h,", "substr(p,")}, child_index, {_MOVED.replace("substr(h,", "substr(c,")} FROM e"""
_CASTS = "b AS (SELECT CAST(user_id AS VARCHAR) AS broadcast_id, max((epoch_us(ts) // 1000)) AS last_updated, max(CASE WHEN event_type = 'error' THEN (epoch_us(ts) // 1000) + 3600000 END) AS expiration FROM events GROUP BY user_id)"
ORACLES["q_list_broadcasts"] = f"WITH {_CASTS} SELECT DISTINCT event_type AS id, broadcast_id, last_updated, expiration FROM b JOIN events ON CAST(user_id AS VARCHAR) = broadcast_id WHERE expiration IS NULL OR expiration > {AS_OF}"
ORACLES["q_update_broadcasts"] = f"WITH {_CASTS} SELECT DISTINCT broadcast_id, 'push' AS action FROM b JOIN events ON CAST(user_id AS VARCHAR) = broadcast_id WHERE (expiration IS NULL OR expiration > {AS_OF}) AND event_type = 'purchase' UNION ALL SELECT broadcast_id, 'delete' FROM b WHERE expiration <= {AS_OF}"
ORACLES["q_pull_episodes"] = f"SELECT event_type AS broadcast_id, CAST(user_id AS VARCHAR) AS id, max((epoch_us(ts) // 1000)) AS episode_ts, arg_max(event_id, ts) AS event_id FROM events WHERE (epoch_us(ts) // 1000) > {AS_OF} GROUP BY ALL"

_MARKED = f"{DOC}, marked AS (SELECT doc_id, line_ix, ['', '# ', '>- ', ',>-# ', '##>#> ', '\\# ', '#'][line_ix % 7 + 1] || line AS line FROM lines)"
_MARKS = "regexp_extract(line, '^([,>#-]+) ', 1)"
ORACLES["q_markup_block_style"] = f"""WITH {_MARKED} SELECT doc_id, line_ix, array_to_string(list_filter([CASE WHEN contains({_MARKS}, '#') THEN 'Heading' END, CASE WHEN contains({_MARKS}, '-') THEN 'List' END, CASE WHEN contains({_MARKS}, '>') THEN 'Quote' END, CASE WHEN contains({_MARKS}, ',') THEN 'Aside' END], lambda s: s IS NOT NULL), ',') AS styles,
CASE WHEN regexp_matches(line, '^[,>#-]+ ') THEN regexp_replace(line, '^[,>#-]+ ', '') WHEN regexp_matches(line, '^\\\\[,>#-]* ') THEN substr(line, 2) ELSE line END AS rest FROM marked"""
