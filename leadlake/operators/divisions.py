"""Administrative divisions: city aliases, street lists, centre points.

The division tables are small next to the companies, but nothing here relies
on it: they are joined by equality on (city, district, street) after their
rows were expanded to every name a city goes by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.fixed_values import STREET_ALIAS_SUFFIXES
from leadlake.functions import geo, region, street
from leadlake.operators.aggregates import filled, value_counts
from leadlake.operators.predicates import clean_street_names
from leadlake.operators.ranking import top_per_key
from leadlake.session import stored, work_dir

STREET_KEY = ["city_key", "district_key"]
CODE = "credit_code"


def by_city_name(divisions: DataFrame, level: str) -> DataFrame:
    """Divisions of a level, one row per name of their city (column city_key)."""
    return divisions.filter(F.col("level") == level).withColumn(
        "city_key", F.explode(region.known_as(F.col("city"), F.col("district")))
    )


def same_city(companies: DataFrame, divisions: DataFrame, level: str, on: list[str]) -> DataFrame:
    """Companies with the divisions of their city under any name, and equal ``on``.

    A company of a placeholder city belongs to the city named by its district.
    """
    own = F.when(region.is_placeholder_city(F.col("city")), region.text(F.col("district")))
    keyed = companies.withColumn("city_key", F.coalesce(own, region.text(F.col("city"))))
    wanted = by_city_name(divisions, level).select(
        "city_key", *on, F.col("row_key"), "center_lng", "center_lat"
    )
    return keyed.join(wanted.dropDuplicates(["city_key", *on, "row_key"]), ["city_key", *on])


# --- street lists and address matching ----------------------------------------


def _list_keys(divisions: DataFrame) -> DataFrame:
    """Street names under each (city, district) key they can be looked up by."""
    rows = divisions.filter((F.col("level") == "street") & filled("street")).withColumn(
        "city_key", F.explode(region.city_names(F.col("city"), F.col("district")))
    )
    city, district = region.text(F.col("city_key")), region.text(F.col("district"))
    empty = F.lit("")
    as_city = (city == district) | F.col("city").contains("直辖")
    keys = F.array(
        F.struct(city.alias("city_key"), district.alias("district_key")),
        F.when(district != "", F.struct(empty.alias("city_key"), district.alias("district_key"))),
        F.when(
            (district != "") & as_city,
            F.struct(district.alias("city_key"), empty.alias("district_key")),
        ),
    )
    return (
        rows.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"),
                    region.text(F.col("street")).alias("street"))
        .select("key.*", "street").distinct()
    )


def street_index(divisions: DataFrame) -> DataFrame:
    """(city_key, district_key, pattern, official, phase, kind, size, first).

    Phase 0 are official names, longest first; phase 1 are base names with
    another kind ('X镇' for 'X街道'). Of several official names with one base the
    longest counts, and the last by text among equally long ones.
    """
    names = _list_keys(divisions)
    official = names.select(
        *STREET_KEY, F.col("street").alias("pattern"), F.col("street").alias("official"),
        F.lit(0).alias("phase"), F.lit(0).alias("kind"),
        (-F.length("street")).alias("size"), F.col("street").alias("first"),
    )
    based = names.withColumn("base", street.base_name(F.col("street"))).filter(F.col("base") != "")
    bases = based.groupBy(*STREET_KEY, "base").agg(
        F.max(F.struct(F.length("street").alias("n"), F.col("street").alias("s"))).alias("best"),
        F.min(F.struct((-F.length("street")).alias("n"), F.col("street").alias("s"))).alias("head"),
    )
    kinds = F.posexplode(F.array(*[F.lit(s) for s in STREET_ALIAS_SUFFIXES])).alias("kind", "suffix")
    aliases = bases.select(*STREET_KEY, "base", "best", "head", kinds).select(
        *STREET_KEY, F.concat("base", "suffix").alias("pattern"), F.col("best.s").alias("official"),
        F.lit(1).alias("phase"), "kind", F.col("head.n").alias("size"), F.col("head.s").alias("first"),
    )
    return official.unionByName(aliases.filter(F.col("pattern") != F.col("official")))


def _lookup_keys(city: Column, district: Column) -> Column:
    """The keys a company's street is looked up by, best first."""
    c, d = region.text(city), region.text(district)
    empty = F.lit("")

    def key(a: Column, b: Column) -> Column:
        return F.struct(a.alias("city_key"), b.alias("district_key"))

    placeholder = region.is_placeholder_city(c) & (d != "")
    own = F.transform(
        region.city_names(c, d),
        lambda n: F.array(F.when(d != "", key(n, d)), key(n, empty)),
    )
    parts = F.concat(
        F.array(F.when(placeholder, key(d, d)), F.when(placeholder, key(d, empty))),
        F.flatten(own),
        F.array(F.when(d != "", key(empty, d)), F.when((c != "") & (d != ""), key(c, d))),
    )
    return F.array_distinct(F.filter(parts, lambda k: k.isNotNull()))


PLACE = ("province", "city", "district")
PLACE_KEY = [f"{c}_key" for c in PLACE]


def with_place_keys(companies: DataFrame) -> DataFrame:
    return companies.withColumns({f"{c}_key": region.text(F.col(c)) for c in PLACE})


def street_candidates(companies: DataFrame, divisions: DataFrame) -> DataFrame:
    """One row per (province, city, district) of the companies: the patterns of
    its addresses and its street names in order of preference.

    The lists are built once per district; their length is the number of
    streets of the district, not a function of the companies.
    """
    places = with_place_keys(companies.select(*PLACE)).select(*PLACE_KEY).distinct()
    keyed = places.select(
        *[F.col(c).alias(f"own_{c}") for c in PLACE_KEY],
        F.posexplode(_lookup_keys(F.col("city_key"), F.col("district_key"))).alias("pos", "key"),
    ).select(*[f"own_{c}" for c in PLACE_KEY], "pos", "key.*")
    listed = keyed.join(street_index(divisions), STREET_KEY)
    item = F.struct("pos", "phase", "kind", "size", "first", "pattern", "official")
    bundled = listed.groupBy(*[f"own_{c}" for c in PLACE_KEY]).agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    bundled = bundled.select(
        *[F.col(f"own_{c}").alias(c) for c in PLACE_KEY],
        F.transform(
            "items", lambda i: F.struct(i["pattern"].alias("pattern"), i["official"].alias("official"))
        ).alias("streets"),
    )
    names = [F.col(c) for c in PLACE_KEY]
    return places.join(bundled, PLACE_KEY, "left").withColumns(
        {
            "prefix": street.prefix_pattern(*names),
            "repeated": street.repeated_region_pattern(*names),
            "regions": street.region_spellings(*names),
        }
    )


def match_streets(companies: DataFrame, divisions: DataFrame, scan: bool = False) -> DataFrame:
    """Add ``matched_street``: the first listed street the address names, or ''.

    With ``scan``, addresses without a listed street are read by pattern.
    Companies are joined once and never multiplied or regrouped.
    """
    joined = with_place_keys(companies).join(street_candidates(companies, divisions), PLACE_KEY)
    cut = street.without_prefix(F.col("address"), F.col("prefix"))
    bodies = joined.withColumn("__body", street.without_zone(cut))
    named = F.filter("streets", lambda s: F.col("__body").contains(s["pattern"]))
    hits = F.filter(named, lambda s: street.street_hit(F.col("__body"), s["pattern"]))
    found = F.try_element_at(hits, F.lit(1))["official"]
    options = [found]
    if scan:
        options.append(street.scanned_street(F.col("__body"), F.col("repeated"), F.col("regions")))
    return bodies.withColumn("matched_street", F.coalesce(*options, F.lit(""))).drop(
        *PLACE_KEY, "prefix", "repeated", "regions", "streets", "__body"
    )


def backfill_streets(
    companies: DataFrame, divisions: DataFrame, provinces=(), only_empty: bool = False, clear_misses: bool = False
) -> DataFrame:
    """Set ``street`` from the address; each scanned row gains a score point.

    A miss keeps the old street unless ``clear_misses`` is set.
    """
    due = F.lit(True)
    if provinces:
        due = due & F.col("province").isin(*provinces)
    if only_empty:
        due = due & (F.col("street").isNull() | (F.col("street") == ""))
    due = F.coalesce(due, F.lit(False))
    matched = match_streets(companies, divisions)
    kept = F.lit(None).cast("string") if clear_misses else F.col("street")
    new = F.when(F.col("matched_street") != "", F.col("matched_street")).otherwise(kept)
    types = dict(companies.dtypes)
    scored = (F.coalesce(F.col("fill_score"), F.lit(0)) + 1).cast(types["fill_score"])
    return matched.withColumns(
        {
            "street": F.when(due, new).otherwise(F.col("street")),
            "fill_score": F.when(due, scored).otherwise(F.col("fill_score")),
        }
    ).drop("matched_street")


# --- centre points --------------------------------------------------------------


def _centres(divisions: DataFrame, level: str, keys: list[str], name: str) -> DataFrame:
    """One centre per key; the first by row key where several share it."""
    located = by_city_name(
        divisions.filter(F.col("center_lng").isNotNull() & F.col("center_lat").isNotNull()), level
    )
    trimmed = located
    for c in ("province", "district", "street"):
        trimmed = trimmed.withColumn(f"{c}_key", region.text(F.col(c)))
    point = F.struct(F.col("row_key"), F.col("center_lng").alias("lng"), F.col("center_lat").alias("lat"))
    return trimmed.groupBy(*keys).agg(F.min(point).alias(name))


def locate(companies: DataFrame, divisions: DataFrame, districts: bool = True) -> DataFrame:
    """Add ``place`` struct(lng, lat, precision): street centre, else district centre.

    Each is looked up with the province first and without it second.
    """
    placeholder = region.is_placeholder_city(F.col("city"))
    keyed = companies.withColumns(
        {
            "province_key": region.text(F.col("province")),
            "district_key": region.text(F.col("district")),
            "street_key": region.text(F.col("street")),
            "city_key": F.when(placeholder, region.text(F.col("district"))).otherwise(
                region.text(F.col("city"))
            ),
        }
    )
    steps = [
        ("__p1", "street", ["province_key", "city_key", "district_key", "street_key"]),
        ("__p2", "street", ["city_key", "district_key", "street_key"]),
    ]
    if districts:
        steps += [
            ("__p3", "district", ["province_key", "city_key", "district_key"]),
            ("__p4", "district", ["city_key", "district_key"]),
        ]
    points = []
    for name, level, keys in steps:
        keyed = keyed.join(_centres(divisions, level, keys, name), keys, "left")
        usable = F.col(f"{level}_key") != ""
        points.append(
            F.when(
                usable & F.col(name).isNotNull(),
                F.struct(
                    F.col(f"{name}.lng").alias("lng"), F.col(f"{name}.lat").alias("lat"),
                    F.lit(level).alias("precision"),
                ),
            )
        )
    names = [s[0] for s in steps]
    keys = ["province_key", "city_key", "district_key", "street_key"]
    return keyed.withColumn("place", F.coalesce(*points)).drop(*names, *keys)


def geocode(
    companies: DataFrame, divisions: DataFrame, metres: float = 120.0, provinces=(), loaded_at: Column | None = None
) -> DataFrame:
    """Give companies in business without coordinates a scattered centre point."""
    due = F.col("lng").isNull() & (F.col("status") == "存续") & F.col("place").isNotNull()
    if provinces:
        due = due & F.col("province").isin(*provinces)
    due = F.coalesce(due, F.lit(False))
    point = geo.jittered(F.col("credit_code"), F.col("place.lng"), F.col("place.lat"), metres)
    types = dict(companies.dtypes)
    new = {
        "lng": point["lng"], "lat": point["lat"], "geo_precision": F.col("place.precision"),
        "fill_score": (F.coalesce(F.col("fill_score"), F.lit(0)) + 1).cast(types["fill_score"]),
    }
    if loaded_at is not None:
        new["geocoded_at"] = loaded_at
    placed = locate(companies, divisions)
    return placed.withColumns(
        {c: F.when(due, v).otherwise(F.col(c)) for c, v in new.items()}
    ).drop("place")


def geocode_by_address(companies: DataFrame, points: DataFrame) -> DataFrame:
    """Coordinates from a table of known addresses (city, address, lng, lat, precision)."""
    known = points.select(
        F.concat_ws("|", region.text(F.col("city")), region.text(F.col("address"))).alias("__place"),
        F.struct("lng", "lat", "precision").alias("__point"),
    )
    known = known.groupBy("__place").agg(F.min("__point").alias("__point"))
    keyed = companies.withColumn(
        "__place", F.concat_ws("|", region.text(F.col("city")), region.text(F.col("address")))
    )
    due = (
        (F.col("has_mobile") == 1) & (F.col("status") == "存续") & filled("address")
        & (F.col("lng").isNull() | F.col("lat").isNull()) & F.col("__point").isNotNull()
    )
    types = dict(companies.dtypes)
    scored = (F.coalesce(F.col("fill_score"), F.lit(0)) + 1).cast(types["fill_score"])
    new = {
        "lng": F.col("__point.lng"), "lat": F.col("__point.lat"),
        "geo_precision": F.col("__point.precision"), "fill_score": scored,
    }
    return keyed.join(known, "__place", "left").withColumns(
        {c: F.when(F.coalesce(due, F.lit(False)), v).otherwise(F.col(c)) for c, v in new.items()}
    ).drop("__place", "__point")


#: Lookups of a map centre in their order: level that answers, zoom, and the parts of the request that must be filled.
CENTRE_LOOKUPS = (
    ("street", "street", 15, ("city", "district", "street")),
    ("street of the city", "street", 15, ("city", "district", "street")),
    ("district", "district", 13, ("city", "district")),
    ("district of the province", "district", 13, ("city", "district", "province")),
    ("city", "city", 11, ("city",)),
    ("first city of the province", "city", 11, ("city", "province")),
    ("province", "province", 8, ("province",)),
)
REQUEST = ("province", "city", "district", "street")
#: Different places whose answers may be sent to all tasks.
SENT_PLACES = 50_000


def _centre_keys(lookup: str, place: dict[str, Column]) -> list[Column]:
    """The two or three texts that must be equal in a request and a division."""
    none = F.lit("")
    keys = {
        "street": [place["city"], place["district"], place["street"]],
        "street of the city": [place["city"], none, place["street"]],
        "district": [place["city"], place["district"], none],
        "district of the province": [place["province"], place["district"], none],
        "city": [place["city"], none, none],
        "first city of the province": [place["province"], none, none],
        "province": [place["province"], none, none],
    }
    return keys[lookup]


def _ranked(rank: int, keys: list[Column], *more: Column) -> Column:
    return F.struct(F.lit(rank).alias("rank"), *[k.alias(f"key{i}") for i, k in enumerate(keys)], *more)


def admin_centres(requests: DataFrame, divisions: DataFrame) -> DataFrame:
    """Map centre and zoom for requests (province, city, district, street, …).

    Street, else the street anywhere in the city, district, the district anywhere
    in the province, city, the first city of the province (urban areas first), or the
    province. The answer depends on the place alone, so every different place is looked
    up once, however many requests name it, and the answers are joined to the requests.
    Up to SENT_PLACES counted places go to all tasks; more are stored and joined by
    Spark's choice.

    Adds ok, lng, lat, zoom, name and the place that was found. A request without
    answer has the zoom of its widest filled part.
    """
    work = work_dir(requests.sparkSession)
    places = stored(requests.select(*REQUEST).distinct(), f"{work}/places")
    centres = place_centres(places, divisions)
    centres = centres.select(*[F.col(c).alias(f"__{c}") for c in centres.columns])
    centres = F.broadcast(centres) if places.count() <= SENT_PLACES else stored(centres, f"{work}/centres")
    same_place = F.lit(True)
    for c in REQUEST:
        same_place = same_place & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return requests.join(centres, same_place, "left").select(
        *[F.col(f"`{c}`") for c in requests.columns],
        *[F.col(f"__{c}").alias(c) for c in ("ok", "lng", "lat", "zoom", "name", *[f"found_{c}" for c in REQUEST])],
    )


def place_centres(places: DataFrame, divisions: DataFrame) -> DataFrame:
    """The answers of ``admin_centres`` for different places.

    Every place becomes its ranked lookups and every division the keys it is found by;
    one join and the least rank give the answer. Of several divisions the one with the
    least row_key, then place, answers.
    """
    own = {c: region.text(F.col(c)) for c in REQUEST}
    city = F.col("city_name")
    lookups = F.array(*[
        F.when(
            F.array_min(F.array(*[F.length(own[c]) for c in needed])) > 0, _ranked(rank, _centre_keys(name, {**own, "city": city}))
        )
        for rank, (name, _, _, needed) in enumerate(CENTRE_LOOKUPS)
    ])
    # A request without city still has its lookup by province.
    names = F.when(own["city"] == "", F.array(F.lit(""))).otherwise(region.city_names(F.col("city"), F.col("district")))
    asked = (
        places.withColumn("city_name", F.explode(names))
        .select(*REQUEST, F.explode_outer(F.filter(lookups, lambda x: x.isNotNull())).alias("ask"))
        .select(*REQUEST, "ask.*")
    )

    place = {c: region.text(F.col(c)) for c in REQUEST}
    kept = {
        "street": REQUEST, "district": REQUEST[:3], "city": REQUEST[:2], "province": REQUEST[:1],
    }
    answers = F.array(*[
        F.when(
            F.col("level") == level,
            _ranked(
                rank, _centre_keys(name, place),
                F.when(place["city"].contains("城区") | F.lit(name != "first city of the province"), 0).otherwise(1).alias("later"),
                F.struct(
                    *[(F.nullif(place[c], F.lit("")) if c in kept[level] else F.lit(None).cast("string")).alias(c) for c in REQUEST],
                    F.col("center_lng").alias("lng"), F.col("center_lat").alias("lat"), F.lit(zoom).alias("zoom"),
                ).alias("centre"),
            ),
        )
        for rank, (name, level, zoom, _) in enumerate(CENTRE_LOOKUPS)
    ])
    found = (
        divisions.filter(F.col("center_lng").isNotNull())
        .select("row_key", F.explode(F.filter(answers, lambda x: x.isNotNull())).alias("answer")).select("row_key", "answer.*")
    )
    order = F.struct("rank", "later", "row_key", "centre")
    best = (
        asked.join(found, ["rank", "key0", "key1", "key2"], "left")
        .groupBy(*REQUEST).agg(F.min_by("centre", F.when(F.col("row_key").isNotNull(), order)).alias("centre"))
    )
    widest = F.when(own["province"] != "", 8).when(own["city"] != "", 11).otherwise(10)
    ok = F.col("centre.lng").isNotNull() & F.col("centre.lat").isNotNull()
    named = F.coalesce(*[F.nullif(own[c], F.lit("")) for c in reversed(REQUEST)], F.lit(""))
    return best.select(
        *REQUEST, ok.alias("ok"), F.when(ok, F.col("centre.lng")).alias("lng"), F.when(ok, F.col("centre.lat")).alias("lat"),
        F.coalesce("centre.zoom", widest).alias("zoom"), named.alias("name"),
        *[F.coalesce(F.col(f"centre.{c}"), own[c]).alias(f"found_{c}") for c in REQUEST],
    )


def streets_with_counts(companies: DataFrame, divisions: DataFrame, n: int | None = None) -> DataFrame:
    """(province, city, district, k, n): official streets of every district with
    their company counts, all or n per district; districts without an official
    list show the streets seen in the data instead."""
    places = ["province", "city", "district"]
    usable = companies.filter(filled("street") & filled("district"))
    counts = usable.groupBy(*places, F.col("street").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    districts = companies.filter(filled("district")).select(*places).distinct()
    own_city = F.when(region.is_placeholder_city(F.col("city")), F.col("district")).otherwise(F.col("city"))
    keyed = districts.withColumn("city_key", own_city)
    listed = by_city_name(divisions.filter(filled("street")), "street").select(
        "city_key", "district", F.col("street").alias("k")
    ).distinct()
    official = keyed.join(listed, ["city_key", "district"]).select(*places, "k")
    with_counts = official.join(counts, [*places, "k"], "left").fillna(0, subset=["n"])
    unlisted = clean_street_names(companies.filter(filled("district"))).join(
        official.select(*places).distinct(), places, "left_anti"
    )
    seen = unlisted.groupBy(*places, F.col("street").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    if n is not None:
        with_counts = top_per_key(with_counts, places, [F.asc("k")], n)
        seen = top_per_key(seen, places, [F.desc("n"), F.asc("k")], n)
    return with_counts.select(*places, "k", "n").unionByName(seen.select(*places, "k", "n"))


def street_top(companies: DataFrame, n: int = 15) -> DataFrame:
    return value_counts(companies, "street", n)
