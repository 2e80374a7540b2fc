"""Registry tables derived by Spark from the given tables.

Customers become companies, orders their contact points, line items their
certificates and tag sources, nations the places, events the change log. Only
exact operations are used, so that another engine can repeat the derivation.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.catalog import vocabulary as v
from leadlake.functions import dates, region
from leadlake.functions.capital import capital_currency, capital_wan
from leadlake.functions.text import lookup, word_array
from leadlake.schemas import Tables
from leadlake.sources.files import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built_once(build):
    """Build a derived table once per session and folder; later calls share the plan."""
    made: dict[tuple[str, str], DataFrame] = {}

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = build(spark, sf_dir)
        return made[key]

    return get


def pick(words, index: Column) -> Column:
    """Word number ``index`` (from 0) of a fixed list; a missing word is NULL."""
    word = F.element_at(word_array(["" if w is None else w for w in words]), (index + 1).cast("int"))
    return F.nullif(word, F.lit("")) if None in words else word


def as_of() -> Column:
    return F.lit(v.AS_OF).cast("date")


def text(c: Column) -> Column:
    return c.cast("string")


def whole(c: Column) -> Column:
    return F.floor(c).cast("long")


def company_name(k: Column) -> Column:
    return F.concat(pick(v.BRANDS, k % 7), F.lpad(text(k), 9, "0"), pick(v.KINDS, k % 6))


def company_code(k: Column) -> Column:
    surrogate = F.concat(F.lit("N"), F.upper(F.substring(F.md5(company_name(k)), 1, 17)))
    given = F.concat(F.lit("91"), F.lpad(text(k), 16, "0"))
    return F.when(k % 9 == 0, surrogate).otherwise(given)


def capital_text(k: Column, balance: Column) -> Column:
    a = whole(F.abs(balance))
    forms = [
        F.concat(text(a), F.lit("万元人民币")),
        F.concat(text(a), F.lit("万美元")),
        F.concat(text(a), F.lit(".5万人民币")),
        F.concat(text(a), F.lit("亿元")),
        text(a),
        F.concat(text(a + 100_000_000), F.lit("万元")),
        F.concat(text(a + 10_000_000), F.lit("万元")),
        F.lit("-"),
        F.concat(text(a), F.lit(",500万港元")),
        F.concat(text(a), F.lit(" 万 日元")),
    ]
    out = forms[-1]
    for i, form in enumerate(forms[:-1]):
        out = F.when(k % 10 == i, form).otherwise(out)
    return out


def city_centre(nation: Column) -> tuple[Column, Column]:
    return 100 + nation * 0.8, 24 + (nation * 7 % 25) * 0.6


def district(k: Column, nation: Column) -> Column:
    return F.when(nation.isin(*v.PLACEHOLDERS), pick(v.COUNTY_CITIES, k % 4)).otherwise(
        pick(v.DISTRICTS, k % 4)
    )


def address(k: Column, nation: Column) -> Column:
    prov, city, dist = pick(v.PROVINCES, nation), pick(v.CITIES, nation), district(k, nation)
    street, number = pick(v.STREETS, F.floor(k / 5) % 6), F.concat(text(k), F.lit("号"))
    forms = [
        F.concat(prov, city, dist, street, F.lit("中山路"), number),
        F.concat(dist, F.lit("·"), street, number),
        F.concat(city, F.lit("高新区"), F.lit("新华乡"), number),
        F.concat(dist, F.lit("中山路"), number, F.lit("（"), street, F.lit("）")),
        F.concat(prov, dist, street, F.lit("居民委员会"), number),
    ]
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(k % 7 == i, form).otherwise(out)
    return out


def contact_type(order: Column, customer: Column) -> Column:
    few = F.when(order % 2 == 0, "landline").otherwise("email")
    usual = F.when(order % 5 <= 2, "mobile").when(order % 5 == 3, "landline").otherwise("email")
    return F.when(customer % 4 == 0, few).otherwise(usual)


def contact_value(kind: Column, n: Column) -> Column:
    return (
        F.when(kind == "mobile", F.concat(F.lit("1"), text(3 + n % 7), F.lpad(text(n), 9, "0")))
        .when(kind == "landline", F.concat(F.lit("010-"), F.lpad(text(n), 8, "0")))
        .otherwise(F.concat(F.lit("user"), text(n), F.lit("@mail"), text(n % 50), F.lit(".com")))
    )


@built_once
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = contact_type(o, c)
    return table(spark, sf_dir, "orders").select(
        company_code(c).alias("credit_code"), kind.alias("contact_type"),
        contact_value(kind, o).alias("contact_value"), F.col("o_orderpriority").alias("source"),
        company_name(c).alias("company_name"), (o % 3 == 0).cast("tinyint").alias("is_primary"),
        F.col("o_orderdate").cast("date").alias("collected_at"),
        F.col("o_orderdate").alias("loaded_at"),
    )


@built_once
def _order_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = contact_type(o, c)

    def count(name: str) -> Column:
        return F.count(F.when(kind == name, 1))

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("int").alias("insured_count"),
        count("mobile").cast("int").alias("mobile_count"), count("landline").alias("landlines"),
        count("email").cast("int").alias("email_count"),
    )


@built_once
def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    # One by one: the planned size of nations joined to regions exceeds that of many customers, and these would be broadcast.
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), n == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(_order_figures(spark, sf_dir), k == F.col("o_custkey"), "left")
    lng, lat = city_centre(n)
    raw, name = capital_text(k, F.col("c_acctbal")), company_name(k)
    founded = F.date_add(F.lit("2000-01-01").cast("date"), (k * 37 % 9300).cast("int"))
    placed = k % 5 != 0
    segment = F.col("c_mktsegment")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    flag = lambda c: (c > 0).cast("tinyint")
    return rows.select(
        company_code(k).alias("credit_code"), name.alias("company_name"),
        region.status(pick(v.STATUS_RAW, k * 3 % 8)).alias("status"),
        F.concat(pick(v.SURNAMES, k % 8), pick(v.GIVEN, F.floor(k / 8) % 6)).alias("legal_person"),
        pick(v.SCALES, k % 6).alias("scale"),
        capital_wan(raw, name).alias("capital_wan"), raw.alias("capital_raw"),
        capital_currency(raw).alias("capital_currency"),
        founded.alias("established"), F.year(founded).cast("smallint").alias("established_year"),
        dates.company_age(founded, as_of()).alias("company_age"),
        pick(v.PROVINCES, n).alias("province"), pick(v.CITIES, n).alias("city"),
        district(k, n).alias("district"),
        F.when(k % 3 != 0, pick(v.STREETS, k % 6)).alias("street"),
        lookup(v.SEGMENTS, segment).alias("industry_l1"),
        segment.alias("industry_l2"), F.col("n_name").alias("industry_l3"),
        zero("insured_count").cast("int").alias("insured_count"),
        address(k, n).alias("address"),
        F.when(k % 4 == 1, F.concat(F.lit("www.c"), text(k), F.lit(".com"))).alias("website"),
        F.when(k % 3 == 1, F.concat(F.lit("简介"), text(k))).alias("intro"),
        pick(v.SCOPES, k % 6).alias("scope"),
        flag(zero("mobile_count")).alias("has_mobile"), flag(zero("landlines")).alias("has_landline"),
        flag(zero("email_count")).alias("has_email"),
        flag(zero("mobile_count") + zero("landlines") + zero("email_count")).alias("has_contact"),
        zero("mobile_count").cast("int").alias("mobile_count"),
        zero("email_count").cast("int").alias("email_count"),
        (20 + k % 10).cast("int").alias("fill_score"),
        F.col("r_name").alias("src_group"), F.col("n_name").alias("src_file"),
        F.when(placed, lng + (k * 7919 % 1000 - 500) / F.lit(5000.0)).alias("lng"),
        F.when(placed, lat + (k * 104729 % 1000 - 500) / F.lit(5000.0)).alias("lat"),
        F.when(placed, F.lit("address")).alias("geo_precision"),
    )


@built_once
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    one, two = pick(v.CHAINS, k % 10), pick(v.CHAINS, F.floor(k / 10) % 10)
    packed = F.array(F.concat_ws(" | ", one, two))
    return table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0).select(
        company_code(k).alias("credit_code"), company_name(k).alias("company_name"),
        F.when(k % 3 == 0, packed).otherwise(F.array(one, two)).alias("chain_industries"),
        F.array(F.concat_ws(" / ", one, two)).alias("chain_nodes"),
        pick(v.POSITION_TEXTS, k % 3).alias("chain_positions"),
        pick(v.RELATIONS, k % 4).alias("relatedness"),
        F.when(k % 2 == 0, F.array(pick(v.HONORS, k % 5))).alias("honors"),
        pick(v.FINANCINGS, k % 5).alias("financing_raw"),
        F.lit(None).cast("string").alias("tag_finance"),
        pick(v.FITS, k % 4).alias("tag_fit"),
        (20 + k * 13 % 75).cast("smallint").alias("lead_score"),
    )


@built_once
def qualifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate per company, year of shipment and return flag."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    year = F.year("l_shipdate")
    grouped = lines.groupBy(F.col("o_custkey").alias("k"), year.alias("y"), "l_returnflag").agg(
        F.min("l_shipdate").cast("date").alias("issue_date")
    )
    k = F.col("k")
    return grouped.select(
        company_code(k).alias("credit_code"), F.lit("hightech").alias("qual_type"),
        F.concat(F.lit("GR"), text(F.col("y")), F.col("l_returnflag"), F.lpad(text(k), 8, "0")).alias("cert_no"),
        company_name(k).alias("company_name"), text(F.col("y")).alias("cert_year"), "issue_date",
        F.make_date(F.col("y") + 3, F.lit(6), F.lit(30)).alias("valid_to"),
        (F.col("l_returnflag") == "R").cast("tinyint").alias("revoked"),
    )


@built_once
def contact_status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {
        "view": "contacted", "click": "interested", "purchase": "blocked", "signup": "rejected",
        "error": "bogus",
    }
    mapped = lookup(states, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        company_code(F.col("user_id")).alias("credit_code"),
        F.concat(F.lit("u"), text(F.col("event_id") % 3)).alias("user_id"), mapped.alias("status"),
        F.col("props").alias("note"), F.col("ts").alias("updated_at"), "event_id",
    )


@built_once
def contact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadlake.operators.upsert import latest_status

    return latest_status(contact_status_changes(spark, sf_dir), ("updated_at", "event_id"))


@built_once
def territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of three users: by province, by city, by province and street."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("u"), text(n % 3)).alias("user_id"), pick(v.PROVINCES, n).alias("province"),
        F.when(n % 2 == 0, pick(v.CITIES, n)).otherwise("").alias("city"), F.lit("").alias("district"),
        F.when(n % 5 == 0, pick(v.STREETS, n % 6)).otherwise("").alias("street"),
    )


@built_once
def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four levels below every nation, as the division tree spells them."""
    n = F.col("n_nationkey")
    lng, lat = city_centre(n)
    indexes = lambda size: F.array(*[F.lit(i) for i in range(size)])
    base = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(indexes(4)).alias("d")).select(
        "n_nationkey", "d", F.explode(indexes(7)).alias("s")
    )
    d, s = F.col("d"), F.col("s")
    dist = district(d, n)
    city = F.when(n.isin(*v.PLACEHOLDERS), dist).otherwise(pick(v.TREE_CITIES, n))
    # s = 0 stands for the district itself, 1 to 6 for its streets.
    street = F.when(s > 0, pick(v.STREETS, F.greatest(s - 1, F.lit(0)))).otherwise("")
    listed = (s > 0) & ((n + d) % 4 != 3)
    low = base.filter((s == 0) | listed).select(
        F.concat_ws("|", F.when(s == 0, "district").otherwise("street"), text(n), text(d), text(s)).alias("row_key"),
        F.when(s == 0, "district").otherwise("street").alias("level"),
        pick(v.PROVINCES, n).alias("province"), city.alias("city"), dist.alias("district"), street.alias("street"),
        F.when((n + d + s) % 7 != 6, lng + d * 0.05 + s * 0.004).alias("center_lng"),
        (lat + d * 0.04 - s * 0.003).alias("center_lat"),
    )
    cities = base.filter(s == 0).select(
        n.alias("n"), pick(v.PROVINCES, n).alias("province"), city.alias("city"),
        lng.alias("center_lng"), lat.alias("center_lat"),
    ).groupBy("n", "province", "city").agg(F.min("center_lng").alias("center_lng"), F.min("center_lat").alias("center_lat"))
    cities = cities.select(
        F.concat_ws("|", F.lit("city"), text(F.col("n")), "city").alias("row_key"), F.lit("city").alias("level"),
        "province", "city", F.lit("").alias("district"), F.lit("").alias("street"), "center_lng", "center_lat",
    )
    provinces = cities.groupBy("province").agg(F.min("center_lng").alias("x"), F.min("center_lat").alias("y")).select(
        F.concat_ws("|", F.lit("province"), "province").alias("row_key"), F.lit("province").alias("level"),
        "province", F.lit("").alias("city"), F.lit("").alias("district"), F.lit("").alias("street"),
        F.col("x").alias("center_lng"), F.col("y").alias("center_lat"),
    )
    return low.unionByName(cities).unionByName(provinces)


@built_once
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw registry rows: one per order, so companies appear in many files."""
    o, k, n = F.col("o_orderkey"), F.col("c_custkey"), F.col("c_nationkey")
    rows = spread(table(spark, sf_dir, "orders")).join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == k
    )
    day = F.col("o_orderdate").cast("date")
    written = (
        F.when(o % 4 == 0, text(day))
        .when(o % 4 == 1, F.concat(text(F.year(day)), F.lit("年"), text(F.month(day)), F.lit("月"), text(F.dayofmonth(day)), F.lit("日")))
        .when(o % 4 == 2, text(F.datediff(day, F.lit("1899-12-30").cast("date"))))
        .otherwise("2020-02-30")
    )
    code = F.when(k % 9 == 0, F.lit("无")).otherwise(F.concat(F.lit(" 91"), F.lpad(text(k), 16, "0"), F.lit(" ")))
    mobile = contact_value(F.lit("mobile"), o)
    return rows.select(
        F.concat(F.lit("　"), company_name(k)).alias("name"), code.alias("credit"),
        pick(v.STATUS_RAW, k * 3 % 8).alias("status"),
        F.when(o % 3 == 0, F.concat(pick(v.SURNAMES, k % 8), pick(v.GIVEN, F.floor(k / 8) % 6))).otherwise("-").alias("legal"),
        F.coalesce(pick(v.SCALES, k % 6), F.lit("-")).alias("scale"),
        capital_text(k, F.col("c_acctbal")).alias("capital"), written.alias("established"),
        F.when(n % 3 == 0, F.regexp_replace(pick(v.PROVINCES, n), "省$|市$", "")).when(n % 3 == 1, pick(v.PROVINCES, n)).otherwise("").alias("province"),
        pick(v.CITIES, n).alias("city"), district(k, n).alias("district"),
        F.col("c_mktsegment").alias("ind1"), text(o % 3000).alias("insured"),
        F.concat_ws("；", mobile, F.lit("12345"), mobile).alias("mobile"),
        F.concat_ws(" ", F.concat(F.lit("010-"), F.lpad(text(o), 8, "0")), contact_value(F.lit("mobile"), o + 1)).alias("landline"),
        F.concat(F.upper(contact_value(F.lit("email"), o)), F.lit(";")).alias("email"),
        F.when(o % 2 == 0, F.concat(F.lit("a@b;"), contact_value(F.lit("email"), o + 7))).otherwise("").alias("email2"),
        F.coalesce(address(k, n), F.lit("")).alias("address"),
        pick(v.SCOPES, k % 6).alias("scope"),
        pick(v.FOLDERS, k % 5).alias("src_group"),
        F.concat(F.lit("part-"), F.col("o_orderpriority")).alias("src_file"), o.alias("row_no"),
    )


@built_once
def chain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw industry-chain rows: one per line item, tagged by part and quantity."""
    # What the rows need of a line item, in few bytes, because they are moved for both joins.
    needed = spread(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_partkey", "l_linenumber", whole(F.col("l_quantity")).alias("q"), (F.col("l_suppkey") % 5).alias("backer"),
        F.col("l_shipdate").cast("date").alias("day"),
    )
    lines = needed.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k, q, line = F.col("o_custkey"), F.col("q"), F.col("l_linenumber")
    code = F.when(k % 9 == 0, F.lit("无")).otherwise(F.concat(F.lit("91"), F.lpad(text(k), 16, "0")))
    # Duplicate (order, line) pairs exist, so the row number has to include more.
    row_no = (
        F.col("l_orderkey") * 10_000_000 + line * 1_000_000 + F.col("l_partkey") % 100_000 * 10
        + q % 10
    )
    return lines.select(
        company_name(k).alias("name"), code.alias("credit"),
        pick(v.CHAINS, F.col("l_partkey") % 10).alias("l1"), F.col("p_type").alias("l2"),
        F.when(q % 2 == 0, F.col("p_brand")).otherwise("-").alias("l3"),
        F.when(line % 2 == 0, F.col("p_brand")).otherwise("").alias("node"),
        pick(v.POSITION_TEXTS, q % 4).alias("position"), pick(v.RELATIONS, line % 4).alias("relatedness"),
        pick(v.FINANCINGS, F.col("backer")).alias("financing"),
        F.concat_ws("，", pick(v.HONORS, q % 5), pick(v.HONORS, line % 5)).alias("honors"),
        F.lit("").alias("src_group"), F.col("day").cast("string").alias("src_file"),
        row_no.alias("row_no"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        companies=companies(spark, sf_dir), contacts=contacts(spark, sf_dir),
        tags=tags(spark, sf_dir), qualifications=qualifications(spark, sf_dir),
        divisions=divisions(spark, sf_dir), contact_status=contact_status(spark, sf_dir),
        territory=territory(spark, sf_dir),
    )
