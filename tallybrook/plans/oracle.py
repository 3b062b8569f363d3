"""SQL (DuckDB) that gives the queries' rows from the same tables."""

from __future__ import annotations

from ..functions.hashing import AVALANCHE, FNV_OFFSET, FNV_PRIME, SECOND_SEED
from ..functions.parsing import offset_spec
from ..operators import hll
from .queries import FILTER, INSTANT, LATE, OTHER, SEGMENT, SIZINGS, UNION

TWO64 = 1 << 64


def hash_sql(text: str, seed: int = 0) -> str:
    """The stable hash of a VARCHAR expression, as UHUGEINT below 2^64."""
    pairs = f"list_transform(range(0, CAST(octet_length(encode({text})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS UHUGEINT))"
    h = f"list_reduce({pairs}, lambda a, b: (xor(a, b) * CAST({FNV_PRIME} AS UHUGEINT)) % CAST('{TWO64}' AS UHUGEINT), CAST('{FNV_OFFSET ^ seed}' AS UHUGEINT))"
    for factor in AVALANCHE:
        h = f"list_transform([{h}], lambda x: (xor(x, x >> 33) * CAST('{factor}' AS UHUGEINT)) % CAST('{TWO64}' AS UHUGEINT))[1]"
    return f"list_transform([{h}], lambda x: xor(x, x >> 33))[1]"


def hex_sql(h: str) -> str:
    return f"lower(lpad(hex(CAST({h} AS UBIGINT)), 16, '0'))"


def registers_sql(source: str, p: int, by: str = "") -> str:
    """Registers of ``source`` (a query with by..., item)."""
    group = f"{by}, " if by else ""
    hashed = f"SELECT {group}{hash_sql('item')} AS h FROM (SELECT DISTINCT {group}item FROM ({source}) WHERE item IS NOT NULL)"
    rest = f"((h * CAST({1 << p} AS UHUGEINT)) % CAST('{TWO64}' AS UHUGEINT))"
    rank = f"CASE WHEN {rest} = 0 THEN {65 - p} ELSE 65 - length(bin(CAST({rest} AS UBIGINT))) END"
    return f"SELECT {group}CAST(h >> {64 - p} AS INTEGER) AS idx, CAST(max({rank}) AS INTEGER) AS rank FROM ({hashed}) GROUP BY {group}2" if by else f"SELECT CAST(h >> {64 - p} AS INTEGER) AS idx, CAST(max({rank}) AS INTEGER) AS rank FROM ({hashed}) GROUP BY 1"


def estimate_sql(registers: str, p: int, by: str = "") -> str:
    m = 1 << p
    group, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    ranks = f"SELECT {group}rank, count(*) AS n FROM ({registers}) GROUP BY {group}rank"
    sums = f"SELECT {group}{m} - sum(n) AS z, sum(n * pow(2.0, -rank) ORDER BY rank) AS s FROM ({ranks}){tail}"
    alpha = hll.ALPHAS.get(m, 0.7213 / (1 + 1.079 / m))
    raw = f"({alpha * m * m} / (z + s))"
    best = f"CASE WHEN {raw} <= {2.5 * m} AND z > 0 THEN {float(m)} * ln({float(m)} / z) ELSE {raw} END"
    return f"SELECT {group}CAST(floor({best} + 0.5) AS BIGINT) AS approx_unique, CAST({hll.relative_error(p)!r} AS DOUBLE) AS relative_error FROM ({sums})"


def items(table: str, column: str, where: str = "TRUE") -> str:
    return f"SELECT CAST({column} AS VARCHAR) AS item FROM {table} WHERE {where}"


def bits_sql(source: str, size) -> str:
    h1, h2 = hash_sql("item"), hash_sql("item", SECOND_SEED)
    step = f"CAST((((a + i * b) % CAST('{TWO64}' AS UHUGEINT)) % {size.bits}) AS BIGINT)"
    return f"SELECT item, {step} AS bit FROM (SELECT item, {h1} AS a, greatest({h2}, CAST(1 AS UHUGEINT)) AS b FROM (SELECT DISTINCT item FROM ({source}))), (SELECT CAST(unnest(range(0, {size.hashes})) AS UHUGEINT) AS i)"


def member_sql(asked: str, held: str, size) -> str:
    """Items of ``asked`` that the filter of ``held`` has."""
    return f"SELECT item FROM ({bits_sql(asked, size)}) a LEFT JOIN (SELECT DISTINCT bit FROM ({bits_sql(held, size)})) b USING (bit) GROUP BY item HAVING count(b.bit) = count(*)"


def ranked_sql(source: str, k: int) -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY n DESC, item) AS INTEGER) AS rank, item, n AS count_estimate FROM (SELECT item, count(*) AS n FROM ({source}) GROUP BY item) ORDER BY rank LIMIT {k}"


def profile_sql(fields: dict[str, str], table: str, p: int = 14) -> str:
    """Each field is an expression for (state, item): state is one of present, null, missing, empty."""
    parts = []
    for name, (state, value) in fields.items():
        cells = f"SELECT {state} AS state, {value} AS item FROM {table}"
        parts.append(
            f"SELECT '{name}' AS field, coalesce((SELECT approx_unique FROM ({estimate_sql(registers_sql(f'SELECT item FROM ({cells}) WHERE state = {chr(39)}present{chr(39)}', p), p)})), 0) AS approx_unique, "
            + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {c}" for s, c in (("null", "nulls"), ("missing", "missing"), ("empty", "empty")))
            + f", count(*) AS total FROM ({cells})"
        )
    return " UNION ALL ".join(parts)


def typed(column: str) -> tuple[str, str]:
    text = f"CAST({column} AS VARCHAR)"
    return f"CASE WHEN {column} IS NULL THEN 'null' WHEN {text} = '' THEN 'empty' ELSE 'present' END", text


KV = """SELECT 'default' AS cf, 'part/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS key, p_name AS value FROM part
UNION ALL SELECT 'people', c_mktsegment || '/' || c_custkey, c_name FROM customer"""
LOG = "SELECT CAST(user_id % 4 AS INTEGER) AS partition, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS off, ts FROM events"
BOUNDS = f"SELECT partition, min(off) AS low, max(off) + 1 AS high FROM ({LOG}) GROUP BY partition"


def plan_sql(new: str, current: str = "'-'", source: str = BOUNDS, where: str = "TRUE") -> str:
    return f"SELECT partition, {current} AS current_offset, CAST({new} AS BIGINT) AS new_offset, CAST(low AS BIGINT) AS low_watermark, CAST(high AS BIGINT) AS high_watermark FROM ({source}) WHERE {where}"


def at_sql(spec: str) -> str:
    millis = offset_spec(spec).value
    first = f"SELECT partition AS p2, min(off) AS at_off FROM ({LOG}) WHERE epoch_us(ts) // 1000 >= {millis} GROUP BY partition"
    return plan_sql("coalesce(at_off, high)", source=f"SELECT * FROM ({BOUNDS}) b LEFT JOIN ({first}) f ON b.partition = f.p2")


def oracle_sql() -> dict[str, str]:
    users, parts, customers = items("events", "user_id"), items("lineitem", "l_partkey"), items("orders", "o_custkey")
    segment, other = (items("customer", "c_custkey", f"c_mktsegment = '{s}'") for s in (SEGMENT, OTHER))
    orders = "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS item FROM orders"
    in_filter = member_sql(customers, segment, FILTER)
    in_union = f"SELECT item FROM ({bits_sql(customers, UNION)}) a LEFT JOIN (SELECT DISTINCT bit FROM ({bits_sql(f'{segment} UNION ALL {other}', UNION)})) b USING (bit) GROUP BY item HAVING count(b.bit) = count(*)"
    stable = f"SELECT item FROM (SELECT CAST(o_orderkey AS VARCHAR) AS item FROM orders) WHERE {hash_sql('item', 42)} < CAST('{int(0.2 * float(TWO64 - 1))}' AS UHUGEINT)"
    white = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
    lines = "SELECT unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL"
    sizes = "SELECT count(*) AS n, CAST(sum(octet_length(encode(v))) AS BIGINT) AS bytes FROM ({})"
    padded = " || '  ' || ".join(f"rpad(CAST({c} AS VARCHAR), {n}, ' ')" for c, n in (("partition", 12), ("current_offset", 16), ("new_offset", 16), ("low_watermark", 16), ("high_watermark", 16)))
    titles = [("Partition", "----------"), ("Current Offset", "--------------"), ("New Offset", "----------"), ("Low Watermark", "-------------"), ("High Watermark", "--------------")]
    ruled = ["  " + "  ".join(t[i].ljust(16 if k else 12) for k, t in enumerate(titles)) for i in (0, 1)]
    top = ["", "  Group : group-a", "  Topic : topic-a", "  Offset: latest (end of partition / high watermark)", "  Mode  : DRY RUN (no changes will be committed)", "", *ruled]
    current = "CASE partition WHEN 0 THEN '7' WHEN 3 THEN '1000000' ELSE '-' END"
    nation_line = "CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 3 END"
    split = lambda i, value: (f"CASE WHEN {i} > {nation_line} THEN 'missing' WHEN {value} = '' THEN 'empty' ELSE 'present' END", value)
    json_a = "CASE o_orderkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'empty' WHEN 4 THEN 'missing' ELSE 'present' END"
    props = "CAST(json_extract(props, '$.k') AS VARCHAR)"
    hexed = lambda v: f"'0x' || lower(hex({v}))"
    name = "encode(n_name)"
    value = f"CASE n_nationkey % 3 WHEN 0 THEN unhex('00FF') WHEN 1 THEN encode('0x' || n_name) ELSE CASE WHEN n_nationkey % 2 = 0 THEN encode('') ELSE {name} END END"
    customer = profile_sql({"c_mktsegment": typed("c_mktsegment"), "c_nationkey": typed("c_nationkey")}, "customer")
    found = {
        "heavy_exact_user": ranked_sql(users, 10),
        "heavy_exact_part": ranked_sql(parts, 20),
        "heavy_bounded_exact_regime": ranked_sql(items("events", "event_type"), 5),
        "heavy_merged": ranked_sql(items("events", "event_type"), 5),
        "heavy_bounded_native": ranked_sql(items("events", "event_type"), 5),
        "heavy_tsv": f"SELECT rank || chr(9) || item || chr(9) || count_estimate AS value FROM ({ranked_sql(items('orders', 'o_orderpriority'), 3)})",
        "hash64_vectors": f"SELECT p_partkey, {hex_sql(hash_sql('p_name'))} AS h, {hex_sql(hash_sql('p_name', 42))} AS h_seed FROM part",
        "hll_count_user": estimate_sql(registers_sql(users, 14), 14),
        "hll_count_part": estimate_sql(registers_sql(parts, 14), 14),
        "hll_registers": registers_sql(customers, 10),
        "hll_by_group": estimate_sql(registers_sql("SELECT event_type, CAST(user_id AS VARCHAR) AS item FROM events", 14, "event_type"), 14, "event_type"),
        "hll_merge_days": f"SELECT CAST(12 AS INTEGER) AS precision, approx_unique, relative_error FROM ({estimate_sql(registers_sql(users, 12), 12)})",
        "hll_merge_registers": estimate_sql(registers_sql(users, 12), 12),
        "hll_inspect": f"SELECT 'hyperloglog' AS type, CAST(1 AS INTEGER) AS version, CAST(10 AS INTEGER) AS precision, CAST(1024 AS INTEGER) AS registers, 'fnv1a64-avalanche-v1' AS hash, approx_unique, relative_error FROM ({estimate_sql(registers_sql(customers, 10), 10)})",
        "hll_precision_sweep": " UNION ALL ".join(f"SELECT CAST({p} AS INTEGER) AS p, * FROM ({estimate_sql(registers_sql(parts, p), p)})" for p in (4, 10, 14)),
        "bloom_sizing": " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS expected, CAST({p} AS DOUBLE) AS rate, CAST(ceil(-{n} * ln({p}) / (ln(2) * ln(2))) AS BIGINT) AS bits, CAST(greatest(1, round(ceil(-{n} * ln({p}) / (ln(2) * ln(2))) / {n} * ln(2))) AS INTEGER) AS hashes" for n, p in SIZINGS),
        "bloom_bits": f"SELECT DISTINCT bit FROM ({bits_sql(segment, FILTER)})",
        "bloom_test_semi": f"SELECT * FROM ({orders}) WHERE item IN ({in_filter})",
        "bloom_test_anti": f"SELECT * FROM ({orders}) WHERE item NOT IN ({in_filter})",
        "bloom_test_joined": f"SELECT * FROM ({orders}) WHERE item IN ({in_filter})",
        "bloom_union": f"SELECT o_orderkey FROM ({orders}) WHERE item IN ({in_union})",
        "bloom_inspect": f"SELECT 'bloom-filter' AS type, CAST(1 AS INTEGER) AS version, CAST({UNION.expected} AS BIGINT) AS expected_items, count(*) AS inserted_items, CAST({UNION.rate} AS DOUBLE) AS false_positive_rate, CAST({UNION.bits} AS BIGINT) AS bit_count, CAST({UNION.hashes} AS INTEGER) AS hash_count, 'fnv1a64-avalanche-v1' AS hash FROM customer WHERE c_mktsegment IN ('{SEGMENT}', '{OTHER}')",
        "bloom_fpr": f"SELECT count(*) AS false_positives FROM ({member_sql('SELECT ' + chr(39) + 'x' + chr(39) + ' || range AS item FROM range(10000)', segment, FILTER)})",
        "semi_exact": f"SELECT * FROM ({orders}) WHERE item IN ({segment})",
        "anti_exact": f"SELECT * FROM ({orders}) WHERE item NOT IN ({segment})",
        "card_typed_events": profile_sql({c: typed(c) for c in ("user_id", "event_type", "props")}, "events"),
        "card_typed_json": f"""SELECT '{{"field":"' || field || '","approx_unique":' || approx_unique || ',"total":' || total || '}}' AS json FROM ({customer})""",
        "card_delimited": profile_sql({"1": split(1, "n_name"), "2": split(2, "CAST(n_regionkey AS VARCHAR)"), "3": split(3, "CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'x' END")}, "nation"),
        "card_csv": profile_sql({"id": typed("n_nationkey"), "name": ("CASE WHEN n_nationkey % 4 = 0 THEN 'empty' ELSE 'present' END", "n_name || ', \"q\"'")}, "nation"),
        "card_json_props": profile_sql({".k": ("'present'", props), ".z": ("'missing'", "''")}, "events"),
        "card_json_values": profile_sql({".a": (json_a, "CASE o_orderkey % 5 WHEN 2 THEN '{\"b\":' || o_custkey || '}' ELSE o_custkey || '.0' END"), ".a.b": ("CASE WHEN o_orderkey % 5 = 2 THEN 'present' ELSE 'missing' END", "CAST(o_custkey AS VARCHAR)")}, "orders", 12),
        "sample_stable": stable,
        "sample_rate_all": "SELECT CAST(o_orderkey AS VARCHAR) AS item FROM orders",
        "sample_rate_none": "SELECT CAST(o_orderkey AS VARCHAR) AS item FROM orders WHERE FALSE",
        "sample_reservoir_size": "SELECT least(500, count(*)) AS n, least(500, count(DISTINCT o_orderkey)) AS distinct_n FROM orders",
        "text_trim_nonempty": f"SELECT doc_id, count(*) AS lines, CAST(sum(length(v)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), {white}) AS v FROM documents) WHERE v <> '' GROUP BY doc_id",
        "union_all_inputs": "SELECT CAST(k AS VARCHAR) AS nation, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
        "scan_lines": sizes.format(f"SELECT v FROM ({lines})"),
        "scan_lines_cleaned": sizes.format(f"SELECT trim(v, {white}) AS v FROM ({lines}) WHERE trim(v, {white}) <> ''"),
        "scan_nul": sizes.format("SELECT text AS v FROM documents WHERE text IS NOT NULL"),
        "scan_verbatim": "SELECT count(*) AS n, count(*) - 1 AS ended, CAST(sum(octet_length(encode(o_orderpriority))) AS BIGINT) AS bytes FROM orders",
        "write_json_array_file": "SELECT p_partkey, p_name FROM part",
        "heavy_json": f"""SELECT '[' || string_agg('{{"rank":' || rank || ',"item":"' || item || '","count_estimate":' || count_estimate || '}}', ',' ORDER BY rank) || ']' AS json FROM ({ranked_sql(parts, 20)})""",
        "heavy_key_values": f"SELECT 'rank=' || rank || chr(10) || 'item=' || item || chr(10) || 'count_estimate=' || count_estimate || chr(10) AS value FROM ({ranked_sql(items('orders', 'o_orderpriority'), 5)})",
        "hll_state_files": estimate_sql(registers_sql(customers, 12), 12),
        "bloom_state_files": f"SELECT * FROM ({orders}) WHERE item IN ({in_filter})",
        "bloom_test_stored": f"SELECT * FROM ({orders}) WHERE item NOT IN ({in_filter})",
        "kv_export_csv": f"SELECT key, value FROM ({KV}) WHERE cf = 'people'",
        "kv_export_json": f"SELECT key, value FROM ({KV}) WHERE cf = 'people'",
        "kv_get": f"SELECT key, value FROM ({KV}) WHERE cf = 'default' AND key = 'part/00000042'",
        "kv_scan_prefix": f"SELECT key, value FROM ({KV}) WHERE cf = 'people' AND starts_with(key, 'BUILDING/1')",
        "kv_scan_limit": f"SELECT key, value FROM ({KV}) WHERE cf = 'default' AND starts_with(key, 'part/0000001') ORDER BY key LIMIT 15",
        "kv_keys": f"SELECT key FROM ({KV}) WHERE cf = 'people' ORDER BY key LIMIT 100",
        "kv_count_prefix": f"SELECT count(*) AS n FROM ({KV}) WHERE cf = 'people' AND starts_with(key, 'MACHINERY/')",
        "kv_put_delete": f"SELECT key, CASE key WHEN 'part/00000001' THEN 'changed' WHEN 'part/00000003' THEN 'second' ELSE value END AS value FROM ({KV}) WHERE cf = 'default' AND key <> 'part/00000002' UNION ALL SELECT 'new', 'row'",
        "kv_export": f"SELECT n_name AS key, CASE WHEN n_nationkey % 3 < 2 OR n_nationkey % 2 = 0 THEN {hexed(value)} ELSE n_name END AS value FROM nation",
        "kv_format": f"SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '(empty)' WHEN 1 THEN {hexed('encode(n_name || chr(233))')} ELSE n_name END AS shown, TRUE AS same FROM nation",
        "kv_families": f"SELECT DISTINCT cf, cf = 'default' AS selected FROM ({KV})",
        "kv_stats": f"SELECT cf, count(*) AS keys, CAST(sum(octet_length(encode(key))) AS BIGINT) AS key_bytes, CAST(sum(octet_length(encode(value))) AS BIGINT) AS value_bytes, min(key) AS least_key, max(key) AS most_key FROM ({KV}) GROUP BY cf",
        "offsets_numeric": plan_sql("120"),
        "offsets_earliest": plan_sql("low"),
        "offsets_latest": plan_sql("high"),
        "offsets_timestamp": at_sql(INSTANT),
        "offsets_timestamp_late": at_sql(LATE),
        "offsets_current": plan_sql("low", current),
        "offsets_warnings": "SELECT *, CASE WHEN new_offset < low_watermark THEN 'below low watermark' WHEN new_offset > high_watermark THEN 'above high watermark' END AS warning FROM (" + plan_sql("15", source=f"SELECT partition, low + 10 * partition AS low, partition * 7 + 6 AS high FROM ({BOUNDS})") + ")",
        "offsets_plan_text": f"SELECT '{chr(10).join(top)}' || chr(10) || string_agg('  ' || {padded} || chr(10), '' ORDER BY partition) || chr(10) AS text FROM ({plan_sql('high', current)})",
        "offsets_warning_lines": "SELECT '  warning: partition ' || partition || ': offset ' || new_offset || CASE WHEN new_offset < low_watermark THEN ' < low watermark ' || low_watermark || ' (will consume from earliest available)' ELSE ' > high watermark ' || high_watermark || ' (consumer will wait for new messages)' END AS value FROM (" + plan_sql("15", source=f"SELECT partition, low + 10 * partition AS low, partition * 7 + 6 AS high FROM ({BOUNDS})") + ") WHERE new_offset < low_watermark OR new_offset > high_watermark",
        "offsets_subset": plan_sql("high", where="partition IN (1, 3)"),
        "greeting": "SELECT 'Hello, world!' AS message",
    }
    return found
