"""Queries over the driver's tables, each of which runs one kernel of the engine on them.

A decorated function is a query; the SQL beside it says what DuckDB should find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encodings, images, numbers, text
from ..operators import relational as op
from .registry import Registry

c = F.col
_all = Registry()
query, queries, oracle_sql = _all.query, _all.queries, _all.oracle_sql


# ---- duplicates and references


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canon FROM documents")
def image_dedup_canonical(t):
    return op.canonical(t("documents"), ["text"], "doc_id").select("doc_id", "canon")


@query("""SELECT lang, sum(bytes * (n - 1))::BIGINT AS saved_bytes, sum(n - 1)::BIGINT AS copies
          FROM (SELECT lang, text, octet_length(encode(text)) AS bytes, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang""")
def dedup_savings(t):
    groups = t("documents").groupBy("lang", "text").agg(F.count("*").alias("n"))
    return groups.groupBy("lang").agg(F.sum(F.octet_length("text") * (c("n") - 1)).alias("saved_bytes"), F.sum(c("n") - 1).alias("copies"))


@query("""SELECT len, count(*) AS texts, sum(n)::BIGINT AS rows_, sum(n * (n - 1) // 2)::BIGINT AS equal_pairs
          FROM (SELECT length(text) AS len, text, count(*) AS n FROM documents GROUP BY ALL) GROUP BY len""")
def hash_bucket_verify(t):
    groups = t("documents").groupBy(F.xxhash64("text").alias("h"), "text").agg(F.count("*").alias("n"))
    pairs = F.expr("n * (n - 1) div 2")
    return groups.groupBy(F.length("text").cast("long").alias("len")).agg(F.count("*").alias("texts"), F.sum("n").alias("rows_"), F.sum(pairs).alias("equal_pairs"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang, source) AS canon FROM documents")
def stream_dedup_compat(t):
    return op.canonical(t("documents"), ["text", "lang", "source"], "doc_id").select("doc_id", "canon")


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def streams_minus_images(t):
    return op.unused(t("documents").select("doc_id", "lang"), t("labels"), ["doc_id"])


@query("""WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canon FROM documents)
          SELECT l.doc_id AS label_id, coalesce(k.canon, l.doc_id) AS doc_id, quality FROM labels l LEFT JOIN k ON k.doc_id = l.doc_id AND k.canon <> k.doc_id""")
def reference_rewrite(t):
    canon = op.canonical(t("documents"), ["text"], "doc_id").where("canon <> doc_id")
    return op.rewrite(t("labels").select(c("doc_id").alias("label_id"), "doc_id", "quality"), canon, "doc_id", "doc_id", "canon")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def unused_resources(t):
    used = t("lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(c("l_partkey").alias("p_partkey"))
    return op.unused(t("part").select("p_partkey", "p_name"), used, ["p_partkey"])


@query("""SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY length(text), doc_id) AS r FROM documents) WHERE r = 1""")
def first_of_group(t):
    d = t("documents")
    return d.groupBy("lang").agg(F.min_by(F.struct("doc_id", "text"), F.struct(F.length("text"), "doc_id")).alias("x")).select("x.doc_id", "x.text")


# ---- graphs


@query("""WITH RECURSIVE r(node) AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT node // 3 FROM r WHERE node > 0)
          SELECT node FROM r WHERE node IN (SELECT doc_id FROM documents)""")
def mask_closure(t):
    edges = t("documents").where("doc_id > 0").select(c("doc_id").alias("src"), F.expr("doc_id div 3").alias("dst"))
    return op.closure(t("labels").where("toxic = 1").select(c("doc_id").alias("node")), edges)


@query("""WITH RECURSIVE n AS (SELECT d.doc_id, CASE WHEN d.doc_id > 0 THEN d.doc_id // 8 END AS up, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
          r AS (SELECT doc_id, up, quality FROM n UNION ALL SELECT r.doc_id, n.up, n.quality FROM r JOIN n ON r.up = n.doc_id WHERE r.quality IS NULL)
          SELECT doc_id, max(quality) AS inherited FROM r GROUP BY doc_id""")
def inherited_attributes(t):
    up = F.when(c("doc_id") > 0, F.expr("doc_id div 8"))
    nodes = t("documents").select("doc_id", up.alias("up")).join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return op.inherited(nodes, "doc_id", "up", "quality").select("doc_id", "inherited")


@query("""SELECT kind, count(*) AS n FROM (
            SELECT 'r' || r_regionkey AS node, 'region' AS kind FROM region WHERE r_regionkey IN (1, 2)
            UNION ALL SELECT 'n' || n_nationkey, 'nation' FROM nation WHERE n_regionkey IN (1, 2)
            UNION ALL SELECT 'c' || c_custkey, 'customer' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 2)
            UNION ALL SELECT 'o' || o_orderkey, 'orders' FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 2)) GROUP BY kind""")
def reachable_objects(t):
    named = lambda kind, key: F.concat(F.lit(kind), c(key).cast("string"))
    edges = (
        t("nation").select(named("r", "n_regionkey").alias("src"), named("n", "n_nationkey").alias("dst"))
        .unionByName(t("customer").select(named("n", "c_nationkey").alias("src"), named("c", "c_custkey").alias("dst")))
        .unionByName(t("orders").select(named("c", "o_custkey").alias("src"), named("o", "o_orderkey").alias("dst")))
    )
    edges = edges.unionByName(edges.where(c("dst").startswith("n")).select(c("dst").alias("src"), c("src").alias("dst")))  # a way back: cycles
    seeds = t("region").where(c("r_regionkey").isin(1, 2)).select(named("r", "r_regionkey").alias("node"))
    kinds = F.create_map(*map(F.lit, ("r", "region", "n", "nation", "c", "customer", "o", "orders")))
    return op.closure(seeds, edges).groupBy(F.element_at(kinds, F.left("node", F.lit(1))).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(DISTINCT turn) AS reached FROM conversations c WHERE turn >= (SELECT min(turn) FROM conversations m WHERE m.conv_id = c.conv_id) GROUP BY conv_id")
def nested_forms(t):
    turns = t("conversations").select("conv_id", "turn")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("node"))
    following = F.lead("turn").over(op.Window.partitionBy("conv_id").orderBy("turn"))
    edges = turns.select("conv_id", c("turn").alias("src"), following.alias("dst")).where("dst IS NOT NULL")
    return op.closure(first, edges, ["conv_id"]).groupBy("conv_id").agg(F.countDistinct("node").alias("reached"))


# ---- ordered state


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS font FROM events""")
def current_font_state(t):
    return op.carried(t("events"), ["user_id"], ["ts", "event_id"], F.when(c("event_type") == "signup", c("value")), "font").select("event_id", "font")


_LINES = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_linenumber, l_partkey, l_suppkey FROM lineitem)"


@query(f"""SELECT l_orderkey, count(*) AS uses, sum(w)::BIGINT AS sum_w, sum(h)::BIGINT AS sum_h FROM (
             SELECT l_orderkey, 1 + (l_partkey % 3) AS w, 1 + (l_suppkey % 4) AS h FROM {_LINES}) GROUP BY l_orderkey""")
def ctm_fold(t):
    li = t("lineitem")
    scale = numbers.matrix(1 + c("l_partkey") % 3, 0, 0, 1 + c("l_suppkey") % 4, c("l_linenumber"), 7)
    none = F.lit(None).cast("array<double>")
    ops = F.array(*[F.struct(F.lit(o).alias("op"), F.lit("/Im0").alias("name"), m.alias("m")) for o, m in (("q", none), ("cm", scale), ("Do", none), ("Q", none))])
    per = li.groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", ops.alias("ops")))), lambda x: x["ops"])).alias("ops"))
    uses = per.select("l_orderkey", numbers.fold_matrix(c("ops")).alias("u"))
    total = lambda f: F.aggregate("u", F.lit(0.0), lambda a, u: a + u[f]).cast("long")
    return uses.select("l_orderkey", F.size("u").cast("long").alias("uses"), total("w").alias("sum_w"), total("h").alias("sum_h"))


@query("""WITH r AS (SELECT *, count(num) OVER (PARTITION BY conv_id ORDER BY turn) AS run, last_value(num IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS base
            FROM (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN length(text) % 200 END AS num FROM conversations))
          SELECT conv_id, turn, coalesce(base, 0) + row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS code FROM r WHERE role <> 'user'""")
def differences_counter(t):
    is_name = c("role") != "user"
    number = F.when(~is_name, F.length("text") % 200)
    return op.differences(t("conversations"), ["conv_id"], "turn", number, is_name).select("conv_id", "turn", c("code").cast("long").alias("code"))


@query("""SELECT l_orderkey, min(n) AS start, count(*) AS length FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS run
            FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)) GROUP BY l_orderkey, run""")
def width_runs(t):
    return op.islands(t("lineitem"), ["l_orderkey"], "l_linenumber")


# ---- groups and sets


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def veto_guard(t):
    return op.vetoed(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey", c("l_quantity") > 40).drop("l_quantity")


@query("SELECT p_partkey AS code FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 47")
def codes_difference(t):
    used = t("lineitem").where("l_quantity > 47").select(c("l_partkey").alias("code"))
    return op.unused(t("part").select(c("p_partkey").alias("code")).distinct(), used, ["code"])


@query("""SELECT user_id, count(*) AS n FROM (SELECT user_id, array_agg(DISTINCT event_type ORDER BY event_type) AS a, array_agg(DISTINCT CASE WHEN value > 50 THEN event_type END ORDER BY CASE WHEN value > 50 THEN event_type END) FILTER (WHERE value > 50) AS b
            FROM events GROUP BY user_id) WHERE b IS NULL OR a <> b GROUP BY user_id""")
def set_gate(t):
    sets = t("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("a"), F.sort_array(F.collect_set(F.when(c("value") > 50, c("event_type")))).alias("b"))
    return sets.where("a <> b").groupBy("user_id").agg(F.count("*").alias("n"))


# ---- images

_DRAWN = "SELECT p_partkey, 100 + p_partkey % 900 AS w, 50 + p_size * 37 AS h, n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY l_partkey) ON l_partkey = p_partkey"


@query(f"""SELECT p_partkey, round(dpi, 6) AS dpi, CASE WHEN go THEN nw ELSE w END::BIGINT AS new_w, CASE WHEN go THEN nh ELSE h END::BIGINT AS new_h FROM (
             SELECT *, dpi > 72 AND NOT (w - nw <= 1 AND h - nh <= 1) AS go FROM (
             SELECT *, greatest(1, floor(w * (72.0::DOUBLE / dpi) + 0.5)) AS nw, greatest(1, floor(h * (72.0::DOUBLE / dpi) + 0.5)) AS nh FROM (
             SELECT p_partkey, w, h, greatest(w / (dw / 72.0::DOUBLE), h / (dh / 72.0::DOUBLE)) AS dpi FROM (
             SELECT *, coalesce(20.0::DOUBLE * n, 612.0::DOUBLE) AS dw, coalesce(15.0::DOUBLE * n, 792.0::DOUBLE) AS dh FROM ({_DRAWN})))))""")
def dpi_target_dims(t):
    drawn = t("lineitem").where("l_quantity > 40").groupBy(c("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    p = t("part").join(drawn, "p_partkey", "left").withColumns({"w": 100 + c("p_partkey") % 900, "h": 50 + c("p_size").cast("long") * 37})
    dpi, w, h = images.target_size(c("w"), c("h"), F.coalesce(20.0 * c("n"), F.lit(612.0)), F.coalesce(15.0 * c("n"), F.lit(792.0)))
    return p.select("p_partkey", F.round(dpi, 6).alias("dpi"), w.alias("new_w"), h.alias("new_h"))


_TABLE = "least(255, greatest(1, (b * (CASE WHEN q0 < 50 THEN 5000 // q0 ELSE 200 - 2 * q0 END) + 50) // 100)) + (CASE WHEN i = c_custkey % 64 THEN c_custkey % 300 ELSE 0 END)"
_QT = f"(SELECT unnest({list(images.LUMINANCE)}) AS b, generate_subscripts({list(images.LUMINANCE)}, 1) - 1 AS i)"


@query(f"""WITH x AS (SELECT c_custkey, i, b, {_TABLE} AS v FROM (SELECT c_custkey, 1 + c_custkey % 100 AS q0 FROM customer), {_QT}),
           e AS (SELECT c_custkey, q, sum(abs(v - least(255, greatest(1, (b * (CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END) + 50) // 100))))::BIGINT AS error
                 FROM x, generate_series(1, 100) AS s(q) GROUP BY c_custkey, q)
           SELECT c_custkey, CASE WHEN min(error) > 128 THEN -1 ELSE arg_min(q, (error, q)) END::INT AS quality FROM e GROUP BY c_custkey""")
def jpeg_quality_estimate(t):
    q0 = 1 + c("c_custkey") % 100
    scale = F.when(q0 < 50, F.floor(5000 / q0)).otherwise(200 - 2 * q0)
    table = F.transform(F.array(*map(F.lit, images.LUMINANCE)), lambda b, i: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((b * scale + 50) / 100))) + F.when(i == c("c_custkey") % 64, c("c_custkey") % 300).otherwise(0))
    return t("customer").select("c_custkey", images.estimate_quality(table).cast("int").alias("quality"))


_PIX = "list_transform(embedding, lambda x: CASE WHEN vec_id % 4 = 0 THEN CASE WHEN x > 0 THEN 255 ELSE 0 END ELSE floor((x::DOUBLE + 1) * 127.5)::INT END)"


def _pixels():
    return F.transform("embedding", lambda x: F.when(c("vec_id") % 4 == 0, F.when(x > 0, 255).otherwise(0)).otherwise(F.floor((x.cast("double") + 1) * 127.5).cast("int")))


@query(f"SELECT vec_id, len(list_filter({_PIX}, lambda v: v > 32 AND v < 224)) = 0 AS is_bitonal FROM embeddings")
def bitonal_detect(t):
    return t("embeddings").select("vec_id", images.is_bitonal(_pixels()).alias("is_bitonal"))


@query(f"""SELECT vec_id, r.r AS row_no, list_sum(list_transform(generate_series(1, 8), lambda i: CASE WHEN px[r.r * 8 + i] >= 224 THEN 1 << (8 - i) ELSE 0 END))::INT AS byte
           FROM (SELECT vec_id, {_PIX} AS px FROM embeddings), generate_series(0, 7) AS r(r) WHERE len(list_filter(px, lambda v: v > 32 AND v < 224)) = 0""")
def bitonal_pack(t):
    rows = t("embeddings").where(images.is_bitonal(_pixels())).select("vec_id", _pixels().alias("px"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("r"))
    return rows.select("vec_id", c("r").cast("long").alias("row_no"), images.pack_row(F.slice("px", c("r") * 8 + 1, 8)).alias("byte"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(255 * (1 - c / 255.0::DOUBLE) * (1 - k / 255.0::DOUBLE) + 0.5)::INT AS r,
            floor(255 * (1 - m / 255.0::DOUBLE) * (1 - k / 255.0::DOUBLE) + 0.5)::INT AS g, floor(255 * (1 - y / 255.0::DOUBLE) * (1 - k / 255.0::DOUBLE) + 0.5)::INT AS b
          FROM (SELECT *, l_partkey % 256 AS c, l_suppkey % 256 AS m, l_orderkey % 256 AS y, l_linenumber * 30 % 256 AS k FROM lineitem)""")
def cmyk_to_rgb(t):
    rgb = images.cmyk_to_rgb(c("l_partkey") % 256, c("l_suppkey") % 256, c("l_orderkey") % 256, c("l_linenumber") * 30 % 256)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[x.alias(n) for x, n in zip(rgb, "rgb")])


_EIGHT = "list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::INT)"


@query(f"SELECT vec_id, array_to_string(list_transform(generate_series(0, 15), lambda i: px[(i // 4) * 16 + (i % 4) * 2 + 1]), ',') AS px FROM (SELECT vec_id, {_EIGHT} AS px FROM embeddings)")
def bilinear_downscale(t):
    px = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int"))
    return t("embeddings").select("vec_id", px.alias("px")).select("vec_id", F.array_join(images.bilinear(c("px"), 8, 8, 4, 4).cast("array<string>"), ",").alias("px"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 3 WHEN p_size % 5 = 1 THEN 1 WHEN p_size % 5 = 2 THEN 4 WHEN p_size % 5 = 3 AND p_partkey % 6 IN (1, 3, 4) THEN p_partkey % 6 ELSE 0 END::BIGINT AS comps FROM part""")
def colorspace_resolve(t):
    space = F.element_at(F.array(*map(F.lit, ("/DeviceRGB", "/DeviceGray", "/DeviceCMYK", "/ICCBased", "/Lab"))), c("p_size") % 5 + 1)
    return t("part").select("p_partkey", images.components(space, c("p_partkey") % 6).cast("long").alias("comps"))


@query("""SELECT page_id, CASE WHEN octet_length(encode(m)) < octet_length(encode(html)) THEN m ELSE html END AS html, octet_length(encode(html)) - least(octet_length(encode(m)), octet_length(encode(html))) AS saved
          FROM (SELECT page_id, html, regexp_replace(html, '<!--.*?-->', '', 'gs') || CASE WHEN page_id % 5 = 0 THEN repeat(' ', 40) ELSE '' END AS m FROM pages)""")
def only_if_smaller(t):
    new = F.concat(text.without_comments(c("html")), F.when(c("page_id") % 5 == 0, F.repeat(F.lit(" "), F.lit(40))).otherwise(""))
    p = t("pages").withColumn("m", new)
    return p.select("page_id", images.only_if_smaller(c("m"), c("html")).alias("html"), (F.octet_length("html") - F.least(F.octet_length("m"), F.octet_length("html"))).cast("long").alias("saved"))


# ---- strings


_TRIM = "regexp_replace(regexp_replace(s, '0+$', ''), '[.]$', '')"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN instr(s, '.') = 0 THEN s WHEN {_TRIM} IN ('', '-') THEN '0' ELSE regexp_replace({_TRIM}, '^(-?)0[.]', '\\1.') END AS t
           FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE '' END || (l_partkey % 3) || CASE WHEN l_linenumber % 2 = 0 THEN '.' || (l_suppkey % 10) || (l_orderkey % 2 * 5) || '00' ELSE '' END AS s FROM lineitem)""")
def trim_number(t):
    tail = F.when(c("l_linenumber") % 2 == 0, F.concat(F.lit("."), c("l_suppkey") % 10, c("l_orderkey") % 2 * 5, F.lit("00"))).otherwise("")
    s = F.concat(F.when(c("l_linenumber") % 3 == 1, "-").otherwise(""), c("l_partkey") % 3, tail)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.trim_number(s).alias("t"))


@query("SELECT event_id, coalesce(try_cast(nullif(regexp_extract(s, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)', 0), '') AS DOUBLE), 0) AS num FROM (SELECT event_id, (event_id % 7) || '.' || (event_id % 100) || event_type AS s FROM events UNION ALL SELECT -event_id, event_type || event_id FROM events)")
def parse_number(t):
    e = t("events")
    both = e.select("event_id", F.concat(c("event_id") % 7, F.lit("."), c("event_id") % 100, "event_type").alias("s")).union(e.select(-c("event_id"), F.concat("event_type", "event_id")))
    return both.select("event_id", numbers.parse_number(c("s")).alias("num"))


# fixed values: codes 128 to 159 of code page 1252, and 128 to 255 of Mac OS Roman
_CP1252 = [
    8364, 129, 8218, 402, 8222, 8230, 8224, 8225, 710, 8240, 352, 8249, 338, 141, 381, 143,
    144, 8216, 8217, 8220, 8221, 8226, 8211, 8212, 732, 8482, 353, 8250, 339, 157, 382, 376,
]
_MAC = (
    "ÄÅÇÉÑÖÜáàâäãåçéèêëíìîïñóòôöõúùûü†°¢£§•¶ß®©™´¨≠ÆØ∞±≤≥¥µ∂∑∏π∫ªºΩæø"
    "¿¡¬√ƒ≈∆«»…\u00a0ÀÃÕŒœ–—“”‘’÷◊ÿŸ⁄€‹›ﬁﬂ‡·‚„‰ÂÊÁËÈÍÎÏÌÓÔ\uf8ffÒÚÛÙıˆ˜¯˘˙˚¸˝˛ˇ"
)


@query(f"SELECT event_id, CASE WHEN event_id % 256 BETWEEN 128 AND 159 THEN {_CP1252}[event_id % 256 - 127] ELSE event_id % 256 END::INT AS unicode FROM events")
def winansi_decode(t):
    return encodings.decode_codes(t("events").select("event_id", (c("event_id") % 256).cast("int").alias("code")), "WinAnsiEncoding").select("event_id", "unicode")


@query(f"SELECT event_id, CASE WHEN event_id % 256 > 127 THEN unicode(substr('{_MAC}', (event_id % 256 - 127)::INT, 1)) ELSE event_id % 256 END::INT AS unicode FROM events")
def macroman_decode(t):
    return encodings.decode_codes(t("events").select("event_id", (c("event_id") % 256).cast("int").alias("code")), "MacRomanEncoding").select("event_id", "unicode")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_partkey % 65536 WHEN 1 THEN 233 WHEN 2 THEN 8364 WHEN 3 THEN 65 WHEN 4 THEN 4096 + p_partkey % 4096 ELSE 0 END::INT AS unicode FROM part""")
def glyph_name_unicode(t):
    k, n = c("p_partkey") % 6, c("p_partkey")
    name = (
        F.when(k == 0, F.concat(F.lit("uni"), F.lpad(F.hex(n % 65536), 4, "0"))).when(k == 1, F.lit("eacute.alt")).when(k == 2, F.lit("Euro"))
        .when(k == 3, F.lit("A.swash")).when(k == 4, F.concat(F.lit("u"), F.hex(4096 + n % 4096))).otherwise(F.concat(F.lit("glyph"), n.cast("string")))
    )
    return encodings.glyph_unicode(t("part").select("p_partkey", name.alias("name"))).select("p_partkey", "unicode")


@query("SELECT p_partkey, regexp_matches(CASE WHEN p_partkey % 2 = 0 THEN '/ABCDE' || chr((65 + p_partkey % 40)::INT) || '+' || p_name ELSE p_name END, '^/?[A-Z]{6}[+].+') AS is_subset FROM part")
def subset_prefix(t):
    name = F.when(c("p_partkey") % 2 == 0, F.concat(F.lit("/ABCDE"), F.char(65 + c("p_partkey") % 40), F.lit("+"), "p_name")).otherwise(c("p_name"))
    return t("part").select("p_partkey", encodings.is_subset_name(name).alias("is_subset"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(w / bw, 6) AS a, round(h / bh, 6) AS d, round(least(x, x2) - 3 * (w / bw), 6) AS e, round(y - 4 * (h / bh), 6) AS f FROM (
            SELECT *, abs(x2 - x) AS w FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_quantity + (CASE WHEN l_linenumber = 2 THEN -1 ELSE 1 END) * (1 + l_partkey % 30) AS x2,
            (l_suppkey % 50)::DOUBLE AS y, (2 + l_linenumber)::DOUBLE AS h, (1 + l_suppkey % 9)::DOUBLE AS bw, (1 + l_partkey % 7)::DOUBLE AS bh FROM lineitem))""")
def widget_matrix(t):
    x, y, d = c("l_quantity"), (c("l_suppkey") % 50).cast("double"), lambda v: F.lit(float(v))
    x2 = x + F.when(c("l_linenumber") == 2, -1).otherwise(1) * (1 + c("l_partkey") % 30)
    box = (d(3), d(4), d(3) + (1 + c("l_suppkey") % 9), d(4) + (1 + c("l_partkey") % 7))
    m = numbers.widget_matrix(box, (x, y, x2, y + (2 + c("l_linenumber"))))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(m[i], 6).alias(n) for i, n in ((0, "a"), (3, "d"), (4, "e"), (5, "f"))])
