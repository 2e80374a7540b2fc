"""The derived registry tables as ANSI SQL, written independently of Spark.

Where the Spark side parses text (capital, status, dates), the SQL side states
the expected value directly from the numbers the text was made of.
"""

from __future__ import annotations

from leadlake.catalog import vocabulary as v


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(lit(x) for x in values) + "]"


def pick(values, index: str) -> str:
    return f"({words(values)})[CAST({index} AS BIGINT) + 1]"


def name(k: str) -> str:
    return f"({pick(v.BRANDS, f'({k}) % 7')} || lpad(CAST({k} AS VARCHAR), 9, '0') || {pick(v.KINDS, f'({k}) % 6')})"


def code(k: str) -> str:
    return (
        f"(CASE WHEN ({k}) % 9 = 0 THEN 'N' || upper(substr(md5({name(k)}), 1, 17)) "
        f"ELSE '91' || lpad(CAST({k} AS VARCHAR), 16, '0') END)"
    )


def ctype(o: str, c: str) -> str:
    return (
        f"(CASE WHEN {c} % 4 = 0 THEN CASE WHEN {o} % 2 = 0 THEN 'landline' ELSE 'email' END "
        f"WHEN {o} % 5 <= 2 THEN 'mobile' WHEN {o} % 5 = 3 THEN 'landline' ELSE 'email' END)"
    )


def mobile(n: str) -> str:
    return f"('1' || CAST(3 + ({n}) % 7 AS VARCHAR) || lpad(CAST({n} AS VARCHAR), 9, '0'))"


def landline(n: str) -> str:
    return f"('010-' || lpad(CAST({n} AS VARCHAR), 8, '0'))"


def mail(n: str) -> str:
    return f"('user' || CAST({n} AS VARCHAR) || '@mail' || CAST(({n}) % 50 AS VARCHAR) || '.com')"


def cvalue(kind: str, n: str) -> str:
    return f"(CASE {kind} WHEN 'mobile' THEN {mobile(n)} WHEN 'landline' THEN {landline(n)} ELSE {mail(n)} END)"


def district(k: str, n: str) -> str:
    return (
        f"(CASE WHEN {n} IN {v.PLACEHOLDERS} THEN {pick(v.COUNTY_CITIES, f'{k} % 4')} "
        f"ELSE {pick(v.DISTRICTS, f'{k} % 4')} END)"
    )


def address(k: str, n: str) -> str:
    prov, city, dist = pick(v.PROVINCES, n), pick(v.CITIES, n), district(k, n)
    street, number = pick(v.STREETS, f"({k} // 5) % 6"), f"CAST({k} AS VARCHAR) || '号'"
    return (
        f"(CASE {k} % 7 WHEN 0 THEN {prov} || {city} || {dist} || {street} || '中山路' || {number} "
        f"WHEN 1 THEN {dist} || '·' || {street} || {number} "
        f"WHEN 2 THEN {city} || '高新区' || '新华乡' || {number} "
        f"WHEN 3 THEN {dist} || '中山路' || {number} || '（' || {street} || '）' "
        f"WHEN 4 THEN {prov} || {dist} || {street} || '居民委员会' || {number} END)"
    )


def capital_text(k: str, a: str) -> str:
    t = lambda x: f"CAST({x} AS VARCHAR)"
    return (
        f"(CASE {k} % 10 WHEN 0 THEN {t(a)} || '万元人民币' WHEN 1 THEN {t(a)} || '万美元' "
        f"WHEN 2 THEN {t(a)} || '.5万人民币' WHEN 3 THEN {t(a)} || '亿元' WHEN 4 THEN {t(a)} "
        f"WHEN 5 THEN {t(f'({a} + 100000000)')} || '万元' WHEN 6 THEN {t(f'({a} + 10000000)')} || '万元' "
        f"WHEN 7 THEN '-' WHEN 8 THEN {t(a)} || ',500万港元' ELSE {t(a)} || ' 万 日元' END)"
    )


def capital_wan(k: str, a: str) -> str:
    """Expected capital: the amount times rate and unit, in exact decimals."""
    d = lambda x: f"CAST({x} AS DECIMAL(18,4))"
    return (
        f"CAST(round(CASE {k} % 10 WHEN 0 THEN {d(a)} WHEN 1 THEN {d(f'{a} * 7.2')} "
        f"WHEN 2 THEN {d(f'{a} + 0.5')} WHEN 3 THEN {d(f'{a} * 10000')} "
        f"WHEN 4 THEN {d(f'{a} * 0.0001')} WHEN 5 THEN {d(f'({a} + 100000000) * 0.0001')} "
        f"WHEN 6 THEN CASE WHEN {k} % 6 = 4 THEN {d(f'{a} + 10000000')} "
        f"ELSE {d(f'({a} + 10000000) * 0.0001')} END "
        f"WHEN 8 THEN {d(f'({a} * 1000 + 500) * 0.92')} WHEN 9 THEN {d(f'{a} * 0.048')} END, 2) AS DECIMAL(20,2))"
    )


def capital_currency(k: str) -> str:
    return (
        f"(CASE {k} % 10 WHEN 0 THEN '元人民币' WHEN 1 THEN '美元' WHEN 7 THEN NULL WHEN 8 THEN '港元' "
        f"WHEN 9 THEN '日元' ELSE '人民币' END)"
    )


def age(day: str) -> str:
    return f"CAST(round(date_diff('day', {day}, DATE '{v.AS_OF}') / 365.25, 1) AS DECIMAL(6,1))"


SEGMENT_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in v.SEGMENTS.items()) + " END"
A = "CAST(floor(abs(c_acctbal)) AS BIGINT)"
K, N = "c_custkey", "CAST(c_nationkey AS BIGINT)"

CTES = {
    "contacts": f"""
        SELECT {code('o_custkey')} AS credit_code, {ctype('o_orderkey', 'o_custkey')} AS contact_type,
               {cvalue(ctype('o_orderkey', 'o_custkey'), 'o_orderkey')} AS contact_value,
               o_orderpriority AS source, {name('o_custkey')} AS company_name,
               CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS is_primary,
               CAST(o_orderdate AS DATE) AS collected_at
        FROM orders""",
    "order_figures": f"""
        SELECT o_custkey, count(*) AS insured_count,
               count(*) FILTER (WHERE {ctype('o_orderkey', 'o_custkey')} = 'mobile') AS mobile_count,
               count(*) FILTER (WHERE {ctype('o_orderkey', 'o_custkey')} = 'landline') AS landlines,
               count(*) FILTER (WHERE {ctype('o_orderkey', 'o_custkey')} = 'email') AS email_count
        FROM orders GROUP BY o_custkey""",
    "companies": f"""
        SELECT {K} AS k, {code(K)} AS credit_code, {name(K)} AS company_name,
               {pick(v.STATUS, f'{K} * 3 % 8')} AS status,
               {pick(v.SURNAMES, f'{K} % 8')} || {pick(v.GIVEN, f'({K} // 8) % 6')} AS legal_person,
               {pick(v.SCALES, f'{K} % 6')} AS scale,
               {capital_wan(K, A)} AS capital_wan, {capital_text(K, A)} AS capital_raw,
               {capital_currency(K)} AS capital_currency,
               DATE '2000-01-01' + CAST({K} * 37 % 9300 AS INTEGER) AS established,
               year(DATE '2000-01-01' + CAST({K} * 37 % 9300 AS INTEGER)) AS established_year,
               {age(f"DATE '2000-01-01' + CAST({K} * 37 % 9300 AS INTEGER)")} AS company_age,
               {pick(v.PROVINCES, N)} AS province, {pick(v.CITIES, N)} AS city, {district(K, N)} AS district,
               CASE WHEN {K} % 3 <> 0 THEN {pick(v.STREETS, f'{K} % 6')} END AS street,
               {SEGMENT_CASE} AS industry_l1, c_mktsegment AS industry_l2, n_name AS industry_l3,
               coalesce(insured_count, 0) AS insured_count, {address(K, N)} AS address,
               CASE WHEN {K} % 4 = 1 THEN 'www.c' || CAST({K} AS VARCHAR) || '.com' END AS website,
               CASE WHEN {K} % 3 = 1 THEN '简介' || CAST({K} AS VARCHAR) END AS intro,
               {pick(v.SCOPES, f'{K} % 6')} AS scope,
               CASE WHEN coalesce(mobile_count, 0) > 0 THEN 1 ELSE 0 END AS has_mobile,
               CASE WHEN coalesce(landlines, 0) > 0 THEN 1 ELSE 0 END AS has_landline,
               CASE WHEN coalesce(email_count, 0) > 0 THEN 1 ELSE 0 END AS has_email,
               CASE WHEN coalesce(mobile_count + landlines + email_count, 0) > 0 THEN 1 ELSE 0 END AS has_contact,
               coalesce(mobile_count, 0) AS mobile_count, coalesce(email_count, 0) AS email_count,
               20 + {K} % 10 AS fill_score, r_name AS src_group, n_name AS src_file,
               CASE WHEN {K} % 5 <> 0 THEN CAST(100 AS DOUBLE) + c_nationkey * CAST(0.8 AS DOUBLE)
                    + ({K} * 7919 % 1000 - 500) / CAST(5000 AS DOUBLE) END AS lng,
               CASE WHEN {K} % 5 <> 0 THEN CAST(24 AS DOUBLE) + (c_nationkey * 7 % 25) * CAST(0.6 AS DOUBLE)
                    + ({K} * 104729 % 1000 - 500) / CAST(5000 AS DOUBLE) END AS lat
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN order_figures ON o_custkey = {K}""",
    "tags": f"""
        SELECT {code(K)} AS credit_code, {name(K)} AS company_name,
               CASE WHEN {K} % 3 = 0
                    THEN [{pick(v.CHAINS, f'{K} % 10')} || ' | ' || {pick(v.CHAINS, f'({K} // 10) % 10')}]
                    ELSE [{pick(v.CHAINS, f'{K} % 10')}, {pick(v.CHAINS, f'({K} // 10) % 10')}] END AS chain_industries,
               [{pick(v.CHAINS, f'{K} % 10')} || ' / ' || {pick(v.CHAINS, f'({K} // 10) % 10')}] AS chain_nodes,
               {pick(v.POSITION_TEXTS, f'{K} % 3')} AS chain_positions,
               {pick(v.RELATIONS, f'{K} % 4')} AS relatedness,
               CASE WHEN {K} % 2 = 0 THEN [{pick(v.HONORS, f'{K} % 5')}] END AS honors,
               {pick(v.FINANCINGS, f'{K} % 5')} AS financing_raw,
               {pick(v.FITS, f'{K} % 4')} AS tag_fit, 20 + {K} * 13 % 75 AS lead_score
        FROM customer WHERE c_acctbal >= 0""",
    "qualifications": f"""
        SELECT {code('o_custkey')} AS credit_code, 'hightech' AS qual_type,
               'GR' || CAST(year(l_shipdate) AS VARCHAR) || l_returnflag || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS cert_no,
               {name('o_custkey')} AS company_name, CAST(year(l_shipdate) AS VARCHAR) AS cert_year,
               CAST(min(l_shipdate) AS DATE) AS issue_date,
               make_date(year(l_shipdate) + 3, 6, 30) AS valid_to,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS revoked
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY o_custkey, year(l_shipdate), l_returnflag""",
    "contact_status": f"""
        SELECT credit_code, user_id, status, note, updated_at FROM (
            SELECT *, row_number() OVER (PARTITION BY credit_code, user_id ORDER BY updated_at DESC, event_id DESC) AS rn
            FROM (SELECT {code('user_id')} AS credit_code, 'u' || CAST(event_id % 3 AS VARCHAR) AS user_id,
                         CASE event_type WHEN 'view' THEN 'contacted' WHEN 'click' THEN 'interested'
                              WHEN 'purchase' THEN 'blocked' WHEN 'signup' THEN 'rejected' END AS status,
                         substr(props, 1, 500) AS note, ts AS updated_at, event_id
                  FROM events WHERE event_type <> 'error') AS changes) AS ranked
        WHERE rn = 1""",
    "territory": f"""
        SELECT 'u' || CAST(n_nationkey % 3 AS VARCHAR) AS user_id, {pick(v.PROVINCES, 'n_nationkey')} AS province,
               CASE WHEN n_nationkey % 2 = 0 THEN {pick(v.CITIES, 'n_nationkey')} ELSE '' END AS city,
               '' AS district,
               CASE WHEN n_nationkey % 5 = 0 THEN {pick(v.STREETS, 'n_nationkey % 6')} ELSE '' END AS street
        FROM nation""",
    "division_grid": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS n, d, s, {pick(v.PROVINCES, 'n_nationkey')} AS province,
               CASE WHEN n_nationkey IN {v.PLACEHOLDERS} THEN {pick(v.COUNTY_CITIES, 'd')}
                    ELSE {pick(v.TREE_CITIES, 'n_nationkey')} END AS city,
               CASE WHEN n_nationkey IN {v.PLACEHOLDERS} THEN {pick(v.COUNTY_CITIES, 'd')}
                    ELSE {pick(v.DISTRICTS, 'd')} END AS district,
               CAST(100 AS DOUBLE) + n_nationkey * CAST(0.8 AS DOUBLE) AS x,
               CAST(24 AS DOUBLE) + (n_nationkey * 7 % 25) * CAST(0.6 AS DOUBLE) AS y
        FROM nation, range(4) AS dd(d), range(7) AS ss(s)""",
    "divisions": f"""
        SELECT CASE WHEN s = 0 THEN 'district' ELSE 'street' END || '|' || CAST(n AS VARCHAR) || '|' || CAST(d AS VARCHAR) || '|' || CAST(s AS VARCHAR) AS row_key,
               CASE WHEN s = 0 THEN 'district' ELSE 'street' END AS level, province, city, district,
               CASE WHEN s > 0 THEN ({words(v.STREETS)})[s] ELSE '' END AS street,
               CASE WHEN (n + d + s) % 7 <> 6 THEN x + d * CAST(0.05 AS DOUBLE) + s * CAST(0.004 AS DOUBLE) END AS center_lng,
               y + d * CAST(0.04 AS DOUBLE) - s * CAST(0.003 AS DOUBLE) AS center_lat
        FROM division_grid WHERE s = 0 OR (n + d) % 4 <> 3
        UNION ALL
        SELECT 'city|' || CAST(n AS VARCHAR) || '|city', 'city', province, city, '', '', min(x), min(y)
        FROM division_grid WHERE s = 0 GROUP BY n, province, city
        UNION ALL
        SELECT 'province|' || province, 'province', province, '', '', '', min(x), min(y)
        FROM division_grid GROUP BY province""",
    "registry_rows": f"""
        SELECT o_orderkey AS row_no, c_custkey AS k, {code(K)} AS credit_code, {name(K)} AS company_name,
               {pick(v.STATUS, f'{K} * 3 % 8')} AS status,
               CASE WHEN o_orderkey % 3 = 0 THEN {pick(v.SURNAMES, f'{K} % 8')} || {pick(v.GIVEN, f'({K} // 8) % 6')} END AS legal_person,
               {pick(v.SCALES, f'{K} % 6')} AS scale, {capital_wan(K, A)} AS capital_wan,
               {capital_text(K, A)} AS capital_raw,
               CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS established,
               CASE WHEN c_nationkey % 3 < 2 THEN {pick(v.PROVINCES, N)}
                    ELSE ['江苏省', '上海市', '广东省', '内蒙古自治区', NULL][c_custkey % 5 + 1] END AS province,
               CASE WHEN c_nationkey % 3 < 2 THEN {pick(v.PROVINCES, N)} END AS own_province,
               {pick(v.CITIES, N)} AS city, {district(K, N)} AS district, c_mktsegment AS industry_l1,
               CAST(o_orderkey % 3000 AS INTEGER) AS insured_count, {address(K, N)} AS address,
               {pick(v.SCOPES, f'{K} % 6')} AS scope,
               {mobile('o_orderkey')} AS m1, {mobile('o_orderkey + 1')} AS m2, {landline('o_orderkey')} AS l1,
               {mail('o_orderkey')} AS e1, CASE WHEN o_orderkey % 2 = 0 THEN {mail('o_orderkey + 7')} END AS e2,
               'part-' || o_orderpriority AS src_file, {pick(v.FOLDERS, f'{K} % 5')} AS src_group,
               -- filled fields: eight always, and those that depend on the row
               10 + CASE WHEN c_custkey % 9 <> 0 THEN 1 ELSE 0 END
                 + CASE WHEN {pick(v.STATUS, f'{K} * 3 % 8')} IS NOT NULL THEN 1 ELSE 0 END
                 + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END
                 + CASE WHEN {pick(v.SCALES, f'{K} % 6')} IS NOT NULL THEN 1 ELSE 0 END
                 + CASE WHEN c_custkey % 10 <> 7 THEN 1 ELSE 0 END
                 + CASE WHEN c_nationkey % 3 < 2 THEN 1 ELSE 0 END
                 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END
                 + CASE WHEN c_custkey % 7 < 5 THEN 1 ELSE 0 END AS fill_score
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "chain_rows": f"""
        SELECT c AS k, {code('c')} AS credit_code, {name('c')} AS company_name, l1, l2, l3, node,
               position, relatedness, financing, h1, h2, row_no, src_file
        FROM (SELECT o_custkey AS c, {pick(v.CHAINS, 'l_partkey % 10')} AS l1, p_type AS l2,
                     CASE WHEN CAST(floor(l_quantity) AS BIGINT) % 2 = 0 THEN p_brand END AS l3,
                     CASE WHEN l_linenumber % 2 = 0 THEN p_brand END AS node,
                     {pick(v.POSITION_TEXTS, 'CAST(floor(l_quantity) AS BIGINT) % 4')} AS position,
                     {pick(v.RELATIONS, 'l_linenumber % 4')} AS relatedness,
                     nullif({pick(v.FINANCINGS, 'l_suppkey % 5')}, '-') AS financing,
                     {pick(v.HONORS, 'CAST(floor(l_quantity) AS BIGINT) % 5')} AS h1,
                     {pick(v.HONORS, 'l_linenumber % 5')} AS h2,
                     strftime(l_shipdate, '%Y-%m-%d') AS src_file,
                     l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey % 100000 * 10
                       + CAST(floor(l_quantity) AS BIGINT) % 10 AS row_no
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) AS x
        WHERE c % 9 <> 0""",
}
NEEDS = {"companies": ("order_figures",), "divisions": ("division_grid",)}


def with_tables(*names: str, body: str) -> str:
    """A statement over the derived tables it names."""
    wanted: list[str] = []
    for n in names:
        for part in (*NEEDS.get(n, ()), n):
            if part not in wanted:
                wanted.append(part)
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted)
    if not ctes:
        return body
    own = body.strip()
    return f"WITH {ctes},\n{own[5:]}" if own.startswith("WITH ") else f"WITH {ctes}\n{own}"
