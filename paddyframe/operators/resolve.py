"""Entity resolution over a three-level place hierarchy (survey 2.J, J1-J6).

Hierarchy tables: ``l1 (l1_id, l1_name)``, ``l2 (l2_id, l2_name, l1_id)``,
``l3 (l3_id, l3_name, l2_id)``; level 1 is the top (province role), level 3
the leaf.  Requests are resolved in batch: one requests table in, one status
row per request out.

Substring predicates ("every word is a substring of the path") are not
evaluated as a nested-loop join: the paths' gram index (``gram_index``) gives
each different list of words its candidates, which are verified with the exact
predicate.  The result equals the brute-force theta join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import gram_index

# --- fixed values: words dropped before the word-fallback match -------------
FALLBACK_STOPWORDS = ["in", "the", "of", "city", "municipality", "province"]
# --- fixed values: words dropped by the hierarchical search, and the
# characters stripped from each word --------------------------------------
SEARCH_NOISE = [
    "weather", "forecast", "temperature", "rain", "humidity", "wind",
    "storm", "typhoon", "heat", "climate", "uv", "visibility", "pressure",
    "in", "the", "of", "for", "is", "at", "what", "how", "want", "get",
    "please", "can", "you", "tell", "show", "give", "me", "i", "to", "a",
    "el", "nino", "nina", "la", "del", "de",
]
SEARCH_STRIP = ",.;:!?()[]\"'"
SEARCH_CAPS = (10, 8, 5)      # provinces, municipalities per province, barangays per municipality
FLAT_CAPS = (10, 10)          # flat fallback: municipalities, barangays
# ---------------------------------------------------------------------------

LEVEL_NAMES = {1: "province", 2: "municipality_city", 3: "barangay"}


def paths(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """Union-all name index: one row per node with its level, own name and ', '-joined path.

    Columns: level, node_id, name, path_text (lower, space-joined leaf..top),
    resolved_name, l1_name, l2_name, l3_name.
    """
    p1 = l1.select(F.lit(1).alias("level"), F.col("l1_id").cast("long").alias("node_id"),
                   F.col("l1_name").alias("name"), F.lower("l1_name").alias("path_text"),
                   F.col("l1_name").alias("resolved_name"), "l1_name",
                   F.lit(None).cast("string").alias("l2_name"), F.lit(None).cast("string").alias("l3_name"))
    m = l2.join(l1, "l1_id")     # hierarchy join (C8)
    p2 = m.select(F.lit(2), F.col("l2_id").cast("long"), F.col("l2_name"),
                  F.concat_ws(" ", F.lower("l2_name"), F.lower("l1_name")),
                  F.concat_ws(", ", "l2_name", "l1_name"), "l1_name", "l2_name", F.lit(None).cast("string"))
    b = l3.join(m, "l2_id")
    p3 = b.select(F.lit(3), F.col("l3_id").cast("long"), F.col("l3_name"),
                  F.concat_ws(" ", F.lower("l3_name"), F.lower("l2_name"), F.lower("l1_name")),
                  F.concat_ws(", ", "l3_name", "l2_name", "l1_name"), "l1_name", "l2_name", "l3_name")
    return p1.unionByName(p2.toDF(*p1.columns)).unionByName(p3.toDF(*p1.columns))


def _strip(q) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(q, r"(?U)^\s+|\s+$", "")


def clean_query(q) -> Column:
    """``re.sub('[^\\w\\s]', ' ', q.strip()).lower()`` with Unicode word classes."""
    return F.lower(F.regexp_replace(_strip(q), r"(?U)[^\w\s]", " "))


def _words(clean: Column, stop: list[str]) -> Column:
    parts = F.split(_strip(clean), r"(?U)\s+")
    stop_arr = F.array(*[F.lit(s) for s in stop])
    return F.filter(parts, lambda w: (w != "") & ~F.array_contains(stop_arr, w))


def _pick(matches: DataFrame, req_key: str) -> DataFrame:
    """First level with any match; its match count and (when single) the match."""
    per = matches.groupBy(req_key, "level").agg(
        F.count(F.lit(1)).alias("n_match"),
        F.min(F.struct("node_id", "resolved_name", "l1_name")).alias("m"))
    return _first_level(per, req_key)


def _first_level(per: DataFrame, req_key: str) -> DataFrame:
    w = Window.partitionBy(req_key).orderBy("level")
    return per.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def resolve(requests: DataFrame, index: DataFrame, req_key: str = "request_id", query_col: str = "query",
            allowed_l1: list[str] | None = None) -> DataFrame:
    """Batch place resolution (J1 exact, J2 word fallback, J4 record).

    status: RESOLVED / AMBIGUOUS / NOT_FOUND / UNSUPPORTED_REGION; precedence
    level 1 > 2 > 3; exactly one match at the first matching level resolves.
    """
    req = requests.select(req_key, query_col, clean_query(F.col(query_col)).alias("_clean"),
                          (F.coalesce(_strip(F.col(query_col)), F.lit("")) == "").alias("_blank"))
    live = req.filter(~F.col("_blank"))
    # Exact, case-insensitive (Unicode lower) equality with the cleaned query
    # nodes of one name and level are counted before the join, so a common name does not fan out
    names = index.groupBy(F.lower("name").alias("_clean"), "level").agg(
        F.count(F.lit(1)).alias("n_match"), F.min(F.struct("node_id", "resolved_name", "l1_name")).alias("m"))
    ex = _first_level(live.join(names, "_clean", "inner").select(req_key, "level", "n_match", "m"), req_key) \
        .withColumn("method", F.lit("exact"))
    # Every remaining word must be a substring of the concatenated path
    rest = live.join(ex.select(req_key), req_key, "left_anti") \
        .withColumn("_words", _words(F.col("_clean"), FALLBACK_STOPWORDS))
    # requests of the same words are searched for once
    found = _pick(gram_index.containing(rest.filter(F.size("_words") > 0), "_words", gram_index.of(index, "path_text")), "_words")
    fb = rest.join(found, "_words").select(req_key, "level", "n_match", "m").withColumn("method", F.lit("fallback"))
    hit = ex.unionByName(fb)
    out = req.join(hit, req_key, "left")
    status = (F.when(F.col("level").isNull(), "NOT_FOUND")
              .when(F.col("n_match") > 1, "AMBIGUOUS"))
    if allowed_l1 is not None:
        status = status.when(~F.col("m.l1_name").isin(list(allowed_l1)), "UNSUPPORTED_REGION")
    status = status.otherwise("RESOLVED")
    res = status == "RESOLVED"     # any other status gives no record
    return out.select(
        req_key, query_col, status.alias("status"), F.col("level"), F.col("method"),
        F.when(res, F.element_at(F.create_map(*[x for k, v in LEVEL_NAMES.items() for x in (F.lit(k), F.lit(v))]),
                                 F.col("level"))).alias("granularity"),
        F.when(res, F.col("m.resolved_name")).alias("resolved_name"),
        F.when(res, F.col("m.l1_name")).alias("province"),
        F.when(res, F.col("m.node_id")).alias("node_id"))


def place_points(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """(level, node_id, latitude, longitude, province_id, province_latitude, province_longitude, region) of every node; the
    levels' tables have latitude and longitude, level 1 the region as well."""
    top = l1.select("l1_id", F.col("l1_id").cast("long").alias("province_id"), F.col("latitude").alias("province_latitude"),
                    F.col("longitude").alias("province_longitude"), "region")
    up = ["province_id", "province_latitude", "province_longitude", "region"]
    p1 = top.select(F.lit(1).alias("level"), F.col("province_id").alias("node_id"), F.col("province_latitude").alias("latitude"),
                    F.col("province_longitude").alias("longitude"), *up)
    mid = l2.join(top, "l1_id")
    p2 = mid.select(F.lit(2).alias("level"), F.col("l2_id").cast("long").alias("node_id"), "latitude", "longitude", *up)
    leaf = l3.join(mid.select("l2_id", *up), "l2_id")
    p3 = leaf.select(F.lit(3).alias("level"), F.col("l3_id").cast("long").alias("node_id"), "latitude", "longitude", *up)
    return p1.unionByName(p2).unionByName(p3)


def resolved_records(resolved: DataFrame, points: DataFrame, regions: list[str]) -> DataFrame:
    """The resolved record in full (J4): ``resolve``'s columns with the region, the place's own point, its province's id and
    point.  Places outside ``regions`` are UNSUPPORTED_REGION and have no record."""
    told = resolved.join(points, ["level", "node_id"], "left")
    outside = (F.col("status") == "RESOLVED") & ~F.coalesce(F.col("region").isin(regions), F.lit(False))
    told = told.withColumn("status", F.when(outside, "UNSUPPORTED_REGION").otherwise(F.col("status")))
    record = ["granularity", "resolved_name", "province", "node_id", *points.columns[2:]]
    return told.withColumns({c: F.when(F.col("status") == "RESOLVED", F.col(c)) for c in record})


def choose_point(action_col, own_lat, own_lon, top_lat, top_lon, own_action: str = "GET_WEATHER_DATA"):
    """Own point for weather actions, the top-level (province) point otherwise."""
    own = F.col(action_col) == own_action
    return (F.when(own, F.col(own_lat)).otherwise(F.col(top_lat)).alias("latitude"),
            F.when(own, F.col(own_lon)).otherwise(F.col(top_lon)).alias("longitude"))


# ---- J3: hierarchical search ----------------------------------------------

def search_words(prompt) -> Column:
    """Lower, strip punctuation, drop noise words and words shorter than 4."""
    toks = F.split(F.coalesce(prompt, F.lit("")), r"\s+")
    strip = F.transform(toks, lambda w: F.btrim(F.lower(w), F.lit(SEARCH_STRIP)))
    noise = F.array(*[F.lit(s) for s in SEARCH_NOISE])
    return F.filter(strip, lambda w: (F.length(w) >= 4) & ~F.array_contains(noise, w))


def search_hierarchy(prompts: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame,
                     key: str = "prompt_id", prompt_col: str = "prompt",
                     caps: tuple[int, int, int] = SEARCH_CAPS, flat_caps: tuple[int, int] = FLAT_CAPS) -> DataFrame:
    """Hierarchical search (J3): matching level-1 nodes, their matching children, their matching
    leaves (``caps`` per parent, source order = id order); flat fallback over levels 2 and 3
    (``flat_caps``) when nothing matched.  Output: (key, seq1, seq2, seq3, kind, line) with ``line`` the node's
    columns joined by ' | '.
    """
    p = prompts.select(key, search_words(F.col(prompt_col)).alias("_words")).filter(F.size("_words") > 0)

    def lvl(df, id_col, name_col, level):
        return df.select(F.lit(level).alias("level"), F.col(id_col).cast("long").alias("node_id"),
                         F.lower(F.col(name_col)).alias("_text"))

    # one any-word match over a level-tagged index serves all levels and the flat fallback
    nodes = lvl(l1, "l1_id", "l1_name", 1).unionByName(lvl(l2, "l2_id", "l2_name", 2)) \
        .unionByName(lvl(l3, "l3_id", "l3_name", 3))
    words = p.select(key, F.explode("_words").alias("_w")).distinct().select(key, F.array("_w").alias("_word"))
    met = gram_index.containing(words, "_word", gram_index.of(nodes, "_text")).select("_word", "level", "node_id")
    # materialised once (reliable checkpoint in the shared checkpoint folder): five consumers below
    hits = cut_lineage(words.join(met, "_word").select(key, "level", "node_id").distinct())
    c1, c2, c3 = caps
    m1 = hits.filter("level = 1").select(key, F.col("node_id").alias("l1_id"))
    m1 = m1.withColumn("r1", F.row_number().over(Window.partitionBy(key).orderBy("l1_id"))).filter(F.col("r1") <= c1)
    m2 = hits.filter("level = 2").select(key, F.col("node_id").alias("l2_id"))
    m2 = m2.join(l2.select(F.col("l2_id").cast("long").alias("l2_id"), F.col("l1_id").cast("long").alias("l1_id")),
                 "l2_id").join(m1, [key, "l1_id"])
    m2 = m2.withColumn("r2", F.row_number().over(Window.partitionBy(key, "l1_id").orderBy("l2_id"))) \
        .filter(F.col("r2") <= c2)
    m3_all = hits.filter("level = 3").select(key, F.col("node_id").alias("l3_id"))
    m3 = m3_all.join(l3.select(F.col("l3_id").cast("long").alias("l3_id"), F.col("l2_id").cast("long").alias("l2_id")),
                     "l3_id").join(m2, [key, "l2_id"])
    m3 = m3.withColumn("r3", F.row_number().over(Window.partitionBy(key, "l2_id").orderBy("l3_id"))) \
        .filter(F.col("r3") <= c3)

    def line(kind, cols):
        return F.concat(F.lit(f"[{kind}] "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]))

    l1c = l1.select(F.col("l1_id").cast("long").alias("l1_id"), line("province", l1.columns).alias("line"))
    l2c = l2.select(F.col("l2_id").cast("long").alias("l2_id"), line("municipality_city", l2.columns).alias("line"))
    l3c = l3.select(F.col("l3_id").cast("long").alias("l3_id"), line("barangay", l3.columns).alias("line"))
    h1 = m1.join(l1c, "l1_id").select(key, F.col("r1").alias("seq1"), F.lit(0).alias("seq2"), F.lit(0).alias("seq3"),
                                      F.lit("province").alias("kind"), "line")
    h2 = m2.join(l2c, "l2_id").select(key, F.col("r1").alias("seq1"), F.col("r2").alias("seq2"), F.lit(0).alias("seq3"),
                                      F.lit("municipality_city").alias("kind"), "line")
    h3 = m3.join(l3c, "l3_id").select(key, F.col("r1").alias("seq1"), F.col("r2").alias("seq2"),
                                      F.col("r3").alias("seq3"), F.lit("barangay").alias("kind"), "line")
    hier = h1.unionByName(h2).unionByName(h3)
    # flat fallback for prompts with no hierarchical line
    f1, f2 = flat_caps
    flat_p = p.select(key).join(hier.select(key).distinct(), key, "left_anti")
    fm2 = hits.filter("level = 2").join(flat_p, key, "left_semi").select(key, F.col("node_id").alias("l2_id"))
    fm2 = fm2.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("l2_id"))).filter(F.col("r") <= f1)
    fm3 = hits.filter("level = 3").join(flat_p, key, "left_semi").select(key, F.col("node_id").alias("l3_id"))
    fm3 = fm3.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("l3_id"))).filter(F.col("r") <= f2)
    flat = (fm2.join(l2c, "l2_id").select(key, F.lit(0).alias("seq1"), F.col("r").alias("seq2"), F.lit(0).alias("seq3"),
                                          F.lit("municipality_city").alias("kind"), "line")
            .unionByName(fm3.join(l3c, "l3_id").select(key, F.lit(0).alias("seq1"), F.lit(0).alias("seq2"),
                                                       F.col("r").alias("seq3"), F.lit("barangay").alias("kind"), "line")))
    # Equal lines of a prompt are one, at the place where it is first seen
    seen = hier.unionByName(flat).groupBy(key, "kind", "line").agg(F.min(F.struct("seq1", "seq2", "seq3")).alias("_at"))
    return seen.select(key, "_at.*", "kind", "line")


# ---- J6: dimension seeding ---------------------------------------------------

def seed_dim(existing: DataFrame, incoming: DataFrame, parents: DataFrame, name_col: str, parent_name_col: str,
             parent_key: str, parent_name_in_dim: str, unique_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Seed a child dimension (J6): trim names, case-insensitive parent lookup (C7),
    unmatched rows dropped (C6), insert-or-ignore on the unique key (A6): the first row
    per key in ``order_cols`` order.  Returns the rows to insert."""
    inc = incoming.withColumn(name_col, F.trim(name_col)).withColumn(parent_name_col, F.trim(parent_name_col))
    par = parents.select(F.lower(F.trim(parent_name_in_dim)).alias("_pn"), F.col(parent_key))
    inc = inc.join(par, F.lower(F.col(parent_name_col)) == F.col("_pn"), "inner").drop("_pn")
    w = Window.partitionBy(*unique_cols).orderBy(*order_cols)
    first = inc.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first.join(existing.select(*unique_cols), unique_cols, "left_anti")
