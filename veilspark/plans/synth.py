"""Tables synthesised from the driver's tables by integer arithmetic, in SQL that both engines read.

``{name}`` stands for a base table. Nothing is random, so both engines make the same rows.
"""

from __future__ import annotations


def digit(expr: str, k: int) -> str:
    return f"(CAST(floor(({expr}) / {10**k}) AS BIGINT) % 10)"


def _check(expr: str) -> str:
    weighted = " + ".join(f"{digit(expr, k)} * {2 + k % 6}" for k in range(9))
    return f"(11 - ({weighted}) % 11)"


def _dv(n: str) -> str:
    return f"CASE WHEN {n} = 11 THEN '0' WHEN {n} = 10 THEN 'K' ELSE CAST({n} AS STRING) END"


BODY = "1000000 + c_custkey * 7919"
GROUPED = "CAST(CAST(floor(body / 1000000) AS BIGINT) AS STRING) || '.' || lpad(CAST(CAST(floor(body / 1000) AS BIGINT) % 1000 AS STRING), 3, '0') || '.' || lpad(CAST(body % 1000 AS STRING), 3, '0')"
PLAIN = "CAST(body AS STRING)"

SYN = {
    # identifiers: every fifth has a wrong check digit; the form follows the key
    "syn_rut": f"""SELECT id, body, dv, id % 5 <> 0 AS valid, form, value, id % 3 = 0 AS labelled,
        CASE WHEN id % 3 = 0 THEN 'El RUT: ' ELSE 'El codigo ' END || value || ' consta' AS text FROM (
        SELECT *, CASE form WHEN 0 THEN {GROUPED} || '-' || dv WHEN 1 THEN {PLAIN} || '-' || dv WHEN 2 THEN {GROUPED} || ' - ' || dv
        WHEN 3 THEN {GROUPED} || '–' || dv WHEN 4 THEN {PLAIN} || dv WHEN 5 THEN replace({GROUPED}, '.', ',') || '-' || dv
        ELSE replace({GROUPED}, '.', ' ') || '-' || dv END AS value FROM (
        SELECT id, body, form, {_dv("CASE WHEN id % 5 = 0 THEN (n + 1) % 11 + 1 ELSE n END")} AS dv FROM (
        SELECT c_custkey AS id, {BODY} AS body, c_custkey % 7 AS form, {_check(BODY)} AS n FROM {{customer}}) z1) z2) z3""",
    # phones: nine national digits; every eleventh is a 600 number of ten
    "syn_phone": """SELECT id, national, form, CASE WHEN id % 11 = 0 THEN '600 ' || substr(national, 2, 3) || ' ' || substr(national, 5, 4)
        ELSE CASE form WHEN 0 THEN '+56 9 ' || substr(national, 2, 4) || ' ' || substr(national, 6, 4) WHEN 1 THEN '+56' || national WHEN 2 THEN '0056' || national
        WHEN 3 THEN '0' || national WHEN 4 THEN national WHEN 5 THEN '(+56) ' || national WHEN 6 THEN substr(national, 2, 4) || ' ' || substr(national, 6, 4)
        ELSE 'fono ' || substr(national, 2, 8) END END AS value FROM (
        SELECT c_custkey AS id, '9' || lpad(CAST((c_custkey * 7919) % 100000000 AS STRING), 8, '2') AS national, c_custkey % 8 AS form FROM {customer}) z""",
    "syn_amount": """SELECT id, n, CASE WHEN id % 3 = 0 THEN 'paga $ ' ELSE 'paga ' END || v || CASE WHEN id % 3 = 1 THEN ' pesos' ELSE ' en total' END AS text,
        CASE WHEN id % 3 = 0 THEN 7 ELSE 5 END AS a, CASE WHEN id % 3 = 0 THEN 7 ELSE 5 END + length(v) AS b FROM (
        SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS n, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) ELSE '12.' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0') || '.500' END AS v FROM {orders}) z""",
    # spans: some are empty, many repeat or contain others
    "syn_span": """SELECT l_orderkey % 1000 AS file, l_linenumber AS page, l_partkey % 200 AS a, l_partkey % 200 + l_suppkey % 40 AS b,
        CASE l_suppkey % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'address' WHEN 2 THEN 'name' WHEN 3 THEN 'rut' WHEN 4 THEN 'phone' ELSE 'url' END AS type,
        CASE l_returnflag WHEN 'A' THEN 'regex' WHEN 'N' THEN 'name_list' ELSE 'context' END AS detector FROM {lineitem}""",
    "syn_box": """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS id, l_orderkey % 1000 AS file, l_linenumber AS page,
        CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST((l_suppkey * 7) % 700 AS DOUBLE) AS y0,
        CAST(l_partkey % 500 + 5 + CAST(l_quantity AS BIGINT) AS DOUBLE) AS x1, CAST((l_suppkey * 7) % 700 + 5 + l_orderkey % 20 AS DOUBLE) AS y1,
        CAST(l_suppkey % 100 AS DOUBLE) / 100 AS score, l_partkey % 3 = 0 AS doubt, l_partkey % 4 = 0 AS optional,
        CASE l_suppkey % 5 WHEN 0 THEN 'rut' WHEN 1 THEN 'name' WHEN 2 THEN 'url' WHEN 3 THEN 'signature' ELSE 'phone' END AS type FROM {lineitem}""",
    "syn_finding": """SELECT o_orderkey AS id, o_custkey % 200 AS file, o_orderkey % 5 AS page, CAST(o_orderkey % 97 AS DOUBLE) + 0.5 AS x, CAST(o_orderkey % 113 AS DOUBLE) + 0.25 AS y,
        CASE o_orderkey % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'address' WHEN 2 THEN 'name' WHEN 3 THEN 'rut' WHEN 4 THEN 'phone' ELSE 'url' END AS type,
        CASE o_custkey % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'suggested' WHEN 2 THEN 'removed' ELSE 'added' END AS status,
        o_orderkey % 3 = 0 AS doubtful, o_custkey % 4 = 1 OR o_orderkey % 5 = 0 AS optional,
        CASE WHEN o_custkey % 4 = 1 OR o_orderkey % 5 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'rut' ELSE 'exception' END END AS optional_reason FROM {orders}""",
    "syn_eval": """SELECT l_orderkey AS file, l_linenumber AS id, CASE l_suppkey % 4 WHEN 0 THEN 'rut' WHEN 1 THEN 'email' WHEN 2 THEN 'name' ELSE 'face' END AS type,
        CASE l_partkey % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'stress' ELSE 'out_of_scope' END AS level, CASE l_linestatus WHEN 'O' THEN 'text' ELSE 'raster' END AS layer,
        l_returnflag AS category, (l_partkey + l_suppkey) % 7 <> 0 AS detected, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE (l_partkey * 3 + l_linenumber) % 13 = 0 END AS leak,
        CAST(l_partkey % 40 AS DOUBLE) AS height, CAST(l_suppkey % 101 AS DOUBLE) / 100 AS coverage, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 21 AS DOUBLE) / 20 END AS core,
        CAST(l_partkey % 97 AS DOUBLE) / 7 AS seconds FROM {lineitem}""",
    "syn_profile": """SELECT c_custkey AS file, CASE WHEN c_custkey % 3 = 0 THEN 'image' ELSE 'pdf' END AS kind, c_custkey % 30 AS pages, c_custkey % 7 AS scanned_pages, c_custkey % 11 AS raster_pages,
        c_custkey % 5 AS regions, c_custkey % 2 AS drawn_regions, CAST(c_custkey % 9 AS DOUBLE) / 4 AS regions_mp, CAST(c_custkey % 3 AS DOUBLE) / 2 AS drawn_regions_mp,
        CASE WHEN c_custkey % 3 = 0 THEN 1 + c_custkey % 4 ELSE 0 END AS frames, CAST(c_custkey % 13 AS DOUBLE) AS megapixels FROM {customer}""",
    "syn_line": """SELECT o_orderkey % 300 AS file, CAST(floor(o_orderkey / 300) AS BIGINT) % 5 AS page, o_orderkey AS line, 600.0 AS width, 800.0 AS height,
        CASE (o_orderkey + CAST(floor(o_orderkey / 1500) AS BIGINT)) % 9 WHEN 0 THEN 'RUT' WHEN 1 THEN 'Nombre:' WHEN 2 THEN 'Correo' WHEN 3 THEN 'Firma' ELSE 'valor ' || CAST(o_orderkey AS STRING) END AS text,
        CAST(20 + (o_custkey % 5) * 110 AS DOUBLE) AS x0, CAST(40 + (CAST(floor(o_orderkey / 1500) AS BIGINT) % 4) * 18 AS DOUBLE) AS y0,
        CAST(20 + (o_custkey % 5) * 110 + 80 AS DOUBLE) AS x1, CAST(40 + (CAST(floor(o_orderkey / 1500) AS BIGINT) % 4) * 18 + 12 AS DOUBLE) AS y1 FROM {orders}""",
    "syn_field": """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'RUT: ' WHEN 1 THEN 'Nombre : ' WHEN 2 THEN 'Correo electronico: ' WHEN 3 THEN 'Domicilio:' WHEN 4 THEN 'Para: ' ELSE 'Asunto: ' END || c_name AS text FROM {customer}""",
    # names; some texts hold an entry of ten words, which stands on the list too
    "syn_name": """SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 20 THEN 'ante ' || p_name || ' ' || p_name || ' firma' ELSE p_name END AS text FROM {part}""",
    "syn_list": """SELECT p_partkey AS pos, CASE WHEN p_partkey % 40 = 20 THEN p_name || ' ' || p_name ELSE p_name END AS entry FROM {part} WHERE p_partkey % 4 = 0""",
    "syn_entry": """SELECT p_partkey AS pos, CASE WHEN p_partkey % 40 = 20 THEN p_name || ' ' || p_name ELSE p_name END AS entry FROM {part}""",
    "syn_action": """SELECT user_id % 500 AS id, event_id AS seq, ts, CASE event_id % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'restore' WHEN 2 THEN 'apply' WHEN 3 THEN 'skip' ELSE 'resize' END AS action FROM {events}""",
    "syn_timing": """SELECT event_type AS stage, event_id AS seq, ts, abs(value) AS seconds, 1 + event_id % 4 AS count FROM {events}""",
    "syn_magic": """SELECT s_suppkey AS id, CASE s_suppkey % 8 WHEN 0 THEN '255044462D312E34' WHEN 1 THEN 'FFD8FFE000104A46' WHEN 2 THEN '89504E470D0A1A0A' WHEN 3 THEN '49492A0008000000'
        WHEN 4 THEN '5249464600000000574542505650' WHEN 5 THEN '0000001866747970686569630000000066747970' WHEN 6 THEN '' ELSE '504B030414000600' END AS h FROM {supplier}""",
}
