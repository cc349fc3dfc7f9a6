"""Queries over the given tables in DataFrame operations: trees, references, codes, functions, matrices, stacks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.document import ACTIVE_KEYS, ACTIVE_TYPES
from quire.operators import curves, merging, nested, predictors, ranges, scans, segments, shapes, trees
from quire.registry import query
from quire.session import scratch_path, stage, table
from quire.sources import records

DEPTH, KIDS = 10, 1400
_LINKS = f"""region_of AS (SELECT n_nationkey, 'R' || n_regionkey AS tree FROM nation),
    c AS (SELECT c_custkey, c_nationkey, c_mktsegment, tree FROM customer JOIN region_of ON n_nationkey = c_nationkey),
    o AS (SELECT o_orderkey, o_orderpriority, tree, c_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders JOIN c ON c_custkey = o_custkey),
    links AS (SELECT 'R' || n_regionkey AS tree, 'R' || n_regionkey AS parent, 'N' || n_nationkey AS node, n_nationkey::BIGINT AS ord FROM nation
        UNION ALL SELECT tree, 'N' || c_nationkey, 'C' || c_custkey, c_custkey FROM c
        UNION ALL SELECT tree, CASE WHEN before IS NULL THEN 'C' || c_custkey ELSE 'O' || before END, 'O' || o_orderkey, 0 FROM o
        UNION ALL SELECT tree, 'C' || c_custkey, 'N' || c_nationkey, 1 FROM c WHERE c_custkey % 10 = 0),
    own AS (SELECT 'R' || r_regionkey AS node, NULL AS segment, r_name AS priority FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, NULL FROM nation WHERE n_nationkey % 2 = 0
        UNION ALL SELECT 'C' || c_custkey, c_mktsegment, NULL FROM c WHERE c_custkey % 3 = 0 UNION ALL SELECT 'O' || o_orderkey, NULL, o_orderpriority FROM o WHERE o_orderkey % 4 = 0)"""


@query(
    f"""WITH RECURSIVE {_LINKS},
    w AS (SELECT 'R' || r_regionkey AS tree, 'R' || r_regionkey AS node, NULL::VARCHAR AS parent, []::BIGINT[] AS path, ['R' || r_regionkey] AS branch, 'in' AS outcome, NULL::VARCHAR AS segment, r_name AS priority FROM region
        UNION ALL SELECT w.tree, l.node, w.node, w.path || [l.ord], w.branch || [l.node],
            CASE WHEN len(w.path) >= {DEPTH} THEN 'too deep' WHEN list_contains(w.branch, l.node) THEN 'cycle' ELSE 'in' END, coalesce(own.segment, w.segment), coalesce(own.priority, w.priority)
        FROM w JOIN links l ON l.tree = w.tree AND l.parent = w.node LEFT JOIN own ON own.node = l.node WHERE w.outcome = 'in' AND l.ord < {KIDS}),
    p AS (SELECT DISTINCT tree, parent FROM links),
    r AS (SELECT w.tree, node, w.parent, path, CASE WHEN outcome <> 'in' THEN outcome WHEN p.parent IS NULL THEN 'leaf' ELSE 'inner' END AS outcome, CASE WHEN outcome = 'in' THEN segment END AS segment,
            CASE WHEN outcome = 'in' THEN priority END AS priority FROM w LEFT JOIN p ON p.tree = w.tree AND p.parent = w.node
        UNION ALL SELECT l.tree, min_by(l.node, l.ord), l.parent, any_value(w.path) || [min(l.ord)], 'too many', NULL, NULL FROM links l JOIN w ON w.tree = l.tree AND w.node = l.parent AND w.outcome = 'in' WHERE l.ord >= {KIDS} GROUP BY l.tree, l.parent)
    SELECT tree, node, parent, len(path)::INTEGER AS depth, array_to_string(path, '.') AS path, outcome, segment, priority FROM r"""
)
def tree_walk(spark, sf_dir):
    """Regions, nations, customers and their orders in chains: what is inherited, where a walk turns round, and where it is cut."""
    nation, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    named = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    none = F.lit(None).cast("string")
    customer = table(spark, sf_dir, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), named("R", "n_regionkey").alias("tree")), "c_nationkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = orders.select("o_orderkey", "o_orderpriority", F.col("o_custkey").alias("c_custkey"), before.alias("before")).join(customer.select("c_custkey", "tree"), "c_custkey")
    links = nation.select(named("R", "n_regionkey").alias("tree"), named("R", "n_regionkey").alias("parent"), named("N", "n_nationkey").alias("node"), F.col("n_nationkey").cast("long").alias("ord"))
    links = links.unionByName(customer.select("tree", named("N", "c_nationkey").alias("parent"), named("C", "c_custkey").alias("node"), F.col("c_custkey").cast("long").alias("ord")))
    parent = F.when(F.col("before").isNull(), named("C", "c_custkey")).otherwise(named("O", "before"))
    links = links.unionByName(orders.select("tree", parent.alias("parent"), named("O", "o_orderkey").alias("node"), F.lit(0).cast("long").alias("ord")))
    links = links.unionByName(customer.filter("c_custkey % 10 = 0").select("tree", named("C", "c_custkey").alias("parent"), named("N", "c_nationkey").alias("node"), F.lit(1).cast("long").alias("ord")))
    roots = table(spark, sf_dir, "region").select(named("R", "r_regionkey").alias("tree"), named("R", "r_regionkey").alias("node"), "r_name")
    of_region = F.col("tree")
    own = roots.select("tree", "node", none.alias("segment"), F.col("r_name").alias("priority"))
    own = own.unionByName(nation.filter("n_nationkey % 2 = 0").select(named("R", "n_regionkey").alias("tree"), named("N", "n_nationkey").alias("node"), F.col("n_name").alias("segment"), none.alias("priority")))
    own = own.unionByName(customer.filter("c_custkey % 3 = 0").select(of_region, named("C", "c_custkey").alias("node"), F.col("c_mktsegment").alias("segment"), none.alias("priority")))
    own = own.unionByName(orders.filter("o_orderkey % 4 = 0").select(of_region, named("O", "o_orderkey").alias("node"), none.alias("segment"), F.col("o_orderpriority").alias("priority")))
    found = trees.walk(roots.select("tree", "node"), links, own, ["segment", "priority"], DEPTH, KIDS)
    return found.withColumn("path", F.concat_ws(".", F.col("path").cast("array<string>")))


#: lineitem's rows in an order of their own: rows that tie have the same matrix.
_LINES = "l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    f"""WITH t AS (SELECT {_LINES}, l_linenumber % 4 AS turns, (l_partkey % 100)::BIGINT AS x, (l_suppkey % 10)::BIGINT AS y, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_LINES}) AS i FROM lineitem),
    r AS (SELECT *, (sum(turns) OVER w) % 4 AS after, (sum(turns) OVER w - turns) % 4 AS before FROM t WINDOW w AS (PARTITION BY l_returnflag ORDER BY i)),
    s AS (SELECT *, sum(CASE before WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END) OVER w AS e, sum(CASE before WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END) OVER w AS f
          FROM r WINDOW w AS (PARTITION BY l_returnflag ORDER BY i))
    SELECT {_LINES}, (CASE after WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::BIGINT AS a, (CASE after WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END)::BIGINT AS b,
        (CASE after WHEN 1 THEN -1 WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS c, (CASE after WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END)::BIGINT AS d, e::BIGINT AS e, f::BIGINT AS f FROM s"""
)
def matrix_products(spark, sf_dir):
    """Quarter turns and shifts of a million lines under three flags, multiplied up in order by blocks."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINES.split(", "))
    turns = F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in m)) for m in ((1, 0, 0, 1), (0, 1, -1, 0), (-1, 0, 0, -1), (0, -1, 1, 0)))), F.col("l_linenumber") % 4 + 1)
    matrix = F.concat(turns, F.array((F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 10).cast("double")))
    found = scans.running_products(lines, ["l_returnflag"], _LINES.split(", ")[1:], matrix)
    return found.select(*_LINES.split(", "), *(F.col("product")[i].cast("long").alias(n) for i, n in enumerate("abcdef")))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'signup') THEN 1 ELSE -1 END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
        FROM events WHERE event_type IN ('view', 'signup', 'click', 'purchase')),
    s AS (SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS stack, NULL::BIGINT AS event_id, NULL::BIGINT AS popped, NULL::INTEGER AS kind, NULL::BIGINT AS level FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL SELECT s.user_id, e.i, CASE WHEN e.kind = 1 AND len(stack) < 5 THEN stack || [e.event_id] WHEN e.kind = -1 AND len(stack) > 0 THEN stack[:-2] ELSE stack END, e.event_id,
            CASE WHEN e.kind = -1 AND len(stack) > 0 THEN stack[-1] END, e.kind, CASE WHEN e.kind = 1 AND len(stack) < 5 THEN len(stack) + 1 WHEN e.kind = -1 AND len(stack) > 0 THEN len(stack) END
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
    SELECT s.event_id, s.user_id, CASE WHEN s.kind = -1 THEN CASE WHEN s.popped IS NULL THEN 'unmatched' ELSE 'close' END WHEN s.level IS NULL THEN 'over cap' WHEN p.event_id IS NULL THEN 'left open' ELSE 'open' END AS outcome,
        s.level, CASE WHEN s.kind = 1 THEN p.event_id END AS close_id FROM s LEFT JOIN s p ON p.popped = s.event_id WHERE s.event_id IS NOT NULL"""
)
def saved_states(spark, sf_dir):
    """Views and signups save a state, clicks and purchases restore one, five deep at most."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    found = scans.paired(events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "signup"), F.col("event_type").isin("click", "purchase"), 5)
    return found.select("event_id", "user_id", "outcome", "level", F.col("mate")["event_id"].alias("close_id"))


_CODES = """words AS (SELECT DISTINCT p_size % 3 AS font, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS word FROM part),
    codes AS (SELECT font, substr(word, 1, 1 + length(word) % 4) AS code, max(word) AS text FROM words WHERE word <> '' GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {_CODES},
    s AS (SELECT p_partkey, p_size % 3 AS font, p_name, 0::BIGINT AS pos, 0::BIGINT AS width, ''::VARCHAR AS code, NULL::VARCHAR AS text FROM part
        UNION ALL SELECT s.p_partkey, s.font, s.p_name, s.pos + s.width, coalesce(length(m.code), 1), coalesce(m.code, substr(p_name, s.pos + s.width + 1, 1)), m.text
        FROM s LEFT JOIN LATERAL (SELECT c.code, c.text FROM codes c WHERE c.font = s.font AND c.code = substr(s.p_name, s.pos + s.width + 1, length(c.code)) ORDER BY length(c.code) DESC LIMIT 1) m ON true
        WHERE s.pos + s.width < length(s.p_name))
    SELECT p_partkey, pos::INTEGER AS pos, width::INTEGER AS width, code, text FROM s WHERE width > 0"""
)
def code_segments(spark, sf_dir):
    """Parts' names cut into the codes of a map of one to four bytes, the longest first."""
    part = table(spark, sf_dir, "part")
    word = F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("word")
    words = part.select((F.col("p_size") % 3).alias("font"), word).distinct().filter("word <> ''")
    code = F.substring("word", F.lit(1), 1 + F.length("word") % 4).cast("binary")
    codes = words.groupBy("font", code.alias("code")).agg(F.max("word").alias("text"))
    texts = part.select("p_partkey", (F.col("p_size") % 3).alias("font"), F.col("p_name").cast("binary").alias("data"))
    return segments.segment(texts, codes).select("p_partkey", "pos", "width", F.col("code").cast("string").alias("code"), "text")


@query(
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS font, (o_orderkey * 7919) % 1000000 AS first, CASE WHEN o_orderkey % 5000 = 0 THEN 1000000 ELSE 1 << (o_orderkey % 12)::INTEGER END AS n, o_custkey FROM orders),
    c AS (SELECT DISTINCT l_linestatus AS font, (l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 1000000 AS code FROM lineitem),
    m AS (SELECT c.font, c.code, max_by(r, r.o_orderkey) AS r FROM c JOIN r ON r.font = c.font AND c.code BETWEEN r.first AND r.first + r.n - 1 GROUP BY ALL)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 1000000 AS code, m.r.o_orderkey AS defined_by, m.r.o_custkey + m.code - m.r.first AS target
    FROM lineitem LEFT JOIN m ON m.font = l_linestatus AND m.code = (l_orderkey * 31 + l_partkey * 17 + l_linenumber) % 1000000"""
)
def code_ranges(spark, sf_dir):
    """Codes of lines in ranges that orders define, from one code to all of them; the last definition holds."""
    length = F.when(F.col("o_orderkey") % 5000 == 0, 1_000_000).otherwise(F.expr("shiftleft(1L, cast(o_orderkey % 12 as int))"))
    first = F.col("o_orderkey") * 7919 % 1_000_000
    defined = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("font"), "o_orderkey", first.alias("first"), (first + length - 1).alias("last"), "o_custkey")
    code = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber")) % 1_000_000
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("font"), code.alias("code"))
    found = ranges.look_up(lines, defined, ["font"], "code", "first", "last", "o_orderkey", "r")
    target = F.col("r.o_custkey") + F.col("code") - F.col("r.first")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "code", F.col("r.o_orderkey").alias("defined_by"), target.alias("target"))


@query(
    """WITH s AS (SELECT n_regionkey AS k, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS idx, n_nationkey / 24.0::DOUBLE AS v FROM nation),
    z AS (SELECT k, max(idx) AS last FROM s GROUP BY k),
    i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_suppkey % 5 AS t, least(greatest(l_extendedprice / 50000 - 0.2, 0), 1)::DOUBLE AS x FROM lineitem),
    b AS (SELECT *, 0.25 + 0.1 * t AS bound FROM i),
    one AS (SELECT *, x >= bound AS later, CASE WHEN x < bound THEN x / bound ELSE 1 - (x - bound) / (1 - bound) END AS y FROM b),
    two AS (SELECT *, CASE WHEN t = 4 AND later THEN 3 ELSE t END AS u, CASE WHEN t = 4 AND later THEN y >= 0.55 ELSE later END AS grown,
        CASE WHEN t = 4 AND later THEN CASE WHEN y < 0.55 THEN y / 0.55 ELSE 1 - (y - 0.55) / 0.45 END ELSE y END AS w FROM one),
    p AS (SELECT two.*, w * last AS place FROM two JOIN z ON z.k = two.u),
    q AS (SELECT p.*, s.v, coalesce(n.v, s.v) AS behind FROM p LEFT JOIN s ON s.k = p.u AND s.idx = floor(place) LEFT JOIN s n ON n.k = p.u AND n.idx = floor(place) + 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(CASE WHEN grown THEN power(w, u + 1) ELSE v * (1 - (place - floor(place))) + behind * (place - floor(place)) END, 6) AS ink,
        round(CASE WHEN grown THEN 1 - power(w, u + 1) ELSE (1 - v) * (1 - (place - floor(place))) + (1 - behind) * (place - floor(place)) END, 6) AS paper FROM q"""
)
def colour_functions(spark, sf_dir):
    """Prices as inputs of stitched functions, whose parts are sampled, exponential or stitched themselves."""
    nation = table(spark, sf_dir, "nation")
    share = F.col("n_nationkey") / 24.0
    idx = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    samples = nation.select(F.concat(F.lit("S"), "n_regionkey").alias("fn"), idx.alias("idx"), F.array(share, 1 - share).alias("value"))
    key = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"))
    numbers, none = F.array(F.lit(0.0), F.lit(1.0)), F.lit(None).cast("double")
    empty = F.lit(None).cast("array<double>")

    def function(letter, kind, **given):
        named = {"low": F.lit(0.0), "high": F.lit(1.0), "c0": empty, "c1": empty, "n": none, "enc0": none, "enc1": none, "floor": empty, "ceil": empty} | given
        return key.select(F.concat(F.lit(letter), "k").alias("fn"), F.lit(kind).alias("kind"), *(c.alias(n) for n, c in named.items()))

    functions = function("S", curves.SAMPLED, floor=F.array(F.lit(0.0), F.lit(0.0)), ceil=F.array(F.lit(1.0), F.lit(1.0)))
    functions = functions.unionByName(function("E", curves.EXPONENTIAL, c0=numbers, c1=F.array(F.lit(1.0), F.lit(0.0)), n=F.col("k") + 1.0)).unionByName(function("T", curves.STITCHED))
    bound = F.lit(0.25) + 0.1 * F.col("k")
    later = F.when(F.col("k") == 4, F.lit("T3")).otherwise(F.concat(F.lit("E"), "k"))
    fn = F.concat(F.lit("T"), "k").alias("fn")
    one = key.select(fn, F.lit(0.0).alias("low"), bound.alias("high"), F.lit(0.0).alias("enc0"), F.lit(1.0).alias("enc1"), F.concat(F.lit("S"), "k").alias("part"))
    two = key.select(fn, bound.alias("low"), F.lit(1.0).alias("high"), F.lit(1.0).alias("enc0"), F.lit(0.0).alias("enc1"), later.alias("part"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("fn"), (F.col("l_extendedprice") / 50000 - 0.2).alias("x"))
    found = curves.evaluate(lines, functions, one.unionByName(two), samples)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(F.col("out")[0], 6).alias("ink"), F.round(F.col("out")[1], 6).alias("paper"))


NODES = 300


@query(
    f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'URI' WHEN 'assistant' THEN 'JavaScript' ELSE 'Launch' END AS s, string_split(text, ' ') AS words FROM conversations),
    n AS (SELECT conv_id, turn, unnest([0, 1, 2 + len(words)]) AS ord, unnest([['Action', s], []::VARCHAR[], ['URI']]) AS found FROM t
        UNION ALL SELECT conv_id, turn, 1 + generate_subscripts(words, 1), unnest(list_transform(words, lambda w: CASE WHEN length(w) % 3 = 0 THEN ['Launch'] ELSE []::VARCHAR[] END || CASE WHEN length(w) % 2 = 0 THEN ['JS'] ELSE []::VARCHAR[] END)) FROM t),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, ord) AS number, count(*) OVER (PARTITION BY conv_id) AS nodes FROM n),
    f AS (SELECT conv_id, nodes, unnest(found) AS name FROM p WHERE number <= {NODES})
    SELECT conv_id, name, count(*) AS n, nodes, least(nodes, {NODES}) AS scanned, nodes > {NODES} AS truncated FROM f GROUP BY ALL"""
)
def nested_audit(spark, sf_dir):
    """Actions in nested values made of conversations: names at the first nodes of each, and which were cut short."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "URI").when(F.col("role") == "assistant", "JavaScript").otherwise("Launch")
    word = lambda w: F.struct(F.when(F.length(w) % 3 == 0, "Launch").alias("Subtype"), F.when(F.length(w) % 2 == 0, w).alias("JS"))
    value = F.struct(F.lit("Action").alias("Type"), kind.alias("S"), F.transform(F.split("text", " "), word).alias("Kids"), F.struct(F.concat(F.lit("#"), F.col("turn").cast("string")).alias("URI")).alias("Next"))
    values = turns.select("conv_id", "turn", F.try_parse_json(F.to_json(value)).alias("value"))
    sums, whole = nested.audit(values, ["conv_id"], ["turn"], "value", sorted(ACTIVE_KEYS), sorted(ACTIVE_TYPES), NODES)
    return sums.join(whole, "conv_id")


@query(
    """WITH RECURSIVE g AS (SELECT vec_id, list_transform(embedding, lambda x: floor(least(greatest((x::DOUBLE + 1) * 127.5, 0), 255))::BIGINT) AS g FROM embeddings),
    s AS (SELECT vec_id, g, 0::BIGINT AS i, []::BIGINT[] AS done FROM g
        UNION ALL SELECT vec_id, g, i + 1, done || [(g[i + 1] + CASE f WHEN 1 THEN l WHEN 2 THEN u WHEN 3 THEN (l + u) // 2 WHEN 4 THEN
            CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END ELSE 0 END) % 256]
        FROM (SELECT *, (vec_id + (i // 8) * (i // 8)) % 5 AS f, CASE WHEN i % 8 >= 2 THEN done[i - 1] ELSE 0 END AS l, CASE WHEN i >= 8 THEN done[i - 7] ELSE 0 END AS u,
            CASE WHEN i >= 8 AND i % 8 >= 2 THEN done[i - 9] ELSE 0 END AS c FROM s) WHERE i < len(g))
    SELECT vec_id, row, array_to_string(done[row * 8 + 1 : least(row * 8 + 8, len(g))], ',') AS data FROM (SELECT vec_id, done, g, unnest(range((len(g) + 7) // 8)) AS row FROM s WHERE i = len(g))"""
)
def predictor_rows(spark, sf_dir):
    """Vectors as eight rows of eight bytes in two colours, under all five filters in turn."""
    gray = F.transform("embedding", lambda x: F.floor(F.least(F.greatest((x.cast("double") + 1) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", gray.alias("g")).filter("size(g) > 0")
    rows = rows.select("vec_id", "g", F.explode(F.sequence(F.lit(0), F.floor((F.size("g") - 1) / 8).cast("int"))).alias("row"))
    rows = rows.select("vec_id", F.col("row").cast("long").alias("row"), F.slice("g", F.col("row") * 8 + 1, 8).alias("data"), ((F.col("vec_id") + F.col("row") * F.col("row")) % 5).alias("filter"))
    return predictors.png(rows, ["vec_id"], 2).select("vec_id", "row", F.concat_ws(",", F.col("data").cast("array<string>")).alias("data"))


@query(
    """WITH v AS (SELECT c_custkey // 8 AS shape, c_custkey AS i, (((c_custkey // 8) * 7919) % 1000 + (c_custkey * 53) % 41 - 20)::DOUBLE AS x, (((c_custkey // 8) * 6007) % 1000 + (c_custkey * 29) % 37 - 18)::DOUBLE AS y FROM customer),
    e AS (SELECT shape, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1 FROM v WINDOW w AS (PARTITION BY shape ORDER BY i)),
    b AS (SELECT shape, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM v GROUP BY shape),
    p AS (SELECT row_number() OVER () AS id, l_orderkey, ((l_orderkey * 7919 + l_linenumber * 104729) % 1000)::DOUBLE AS x, ((l_partkey * 6007 + l_suppkey * 31) % 1000)::DOUBLE AS y FROM lineitem),
    m AS (SELECT p.*, b.shape FROM p JOIN b ON p.x BETWEEN b.a AND b.b AND p.y BETWEEN b.c AND b.d),
    w AS (SELECT m.id, m.shape, any_value(m.l_orderkey) AS l_orderkey, sum(CASE WHEN y0 <= y AND y < y1 AND (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) > 0 THEN 1 WHEN y1 <= y AND y < y0 AND (x1 - x0) * (y - y0) - (x - x0) * (y1 - y0) < 0 THEN -1 ELSE 0 END) AS n
          FROM m JOIN e ON e.shape = m.shape GROUP BY m.id, m.shape)
    SELECT shape, count(*) AS nonzero, count_if(abs(n) % 2 = 1)::BIGINT AS even_odd, sum(n)::BIGINT AS windings, max(abs(n))::BIGINT AS most, sum(l_orderkey)::BIGINT AS orders FROM w WHERE n <> 0 GROUP BY shape"""
)
def points_in_shapes(spark, sf_dir):
    """Lines as points in polygons of customers, which cross themselves, so that the two rules differ."""
    place = F.floor(F.col("c_custkey") / 8)
    corners = table(spark, sf_dir, "customer").select(place.alias("shape"), "c_custkey", (place * 7919 % 1000 + F.col("c_custkey") * 53 % 41 - 20).alias("x"), (place * 6007 % 1000 + F.col("c_custkey") * 29 % 37 - 18).alias("y"))
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1000).alias("x"), ((F.col("l_partkey") * 6007 + F.col("l_suppkey") * 31) % 1000).alias("y"))
    places = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_orderkey").alias("orders"))
    found = shapes.winding(places, shapes.closed(corners, ["shape"], [], "c_custkey"), [], ["shape"], 8)
    odd = F.when(F.abs("winding") % 2 == 1, F.col("lines")).otherwise(0)
    return found.groupBy("shape").agg(F.sum("lines").alias("nonzero"), F.sum(odd).alias("even_odd"), F.sum(F.col("winding") * F.col("lines")).alias("windings"), F.max(F.abs("winding")).alias("most"), F.sum("orders").alias("orders"))


_FILES = """d AS (SELECT printf('%012d', doc_id) AS path, sha256(coalesce(text, '')) AS sha256, 1 + length(coalesce(text, '')) // 1000 AS pages, length(coalesce(text, '')) AS size FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) = 1 AS first FROM d),
    p AS (SELECT path, size, unnest(range(1, pages + 1)) AS page_no FROM o WHERE first),
    f AS (SELECT path, page_no, 'size:' || size // 5000 AS feature, 1 AS n FROM p UNION ALL SELECT path, page_no, 'length:' || size % 13, page_no FROM p UNION ALL SELECT path, page_no, 'operator:' || (size + page_no) % 11, size FROM p)"""


def _census_state(spark, sf_dir):
    """documents as files of pages with features, added in three batches."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    files = docs.select(F.format_string("%012d", "doc_id").alias("path"), F.sha2(text.cast("binary"), 256).alias("sha256"), (1 + F.floor(F.length(text) / 1000)).alias("pages"), F.length(text).alias("size"), (F.col("doc_id") % 3).alias("batch"))
    files, state = stage(files, "census-input"), scratch_path(spark, "census-state")
    for batch in (2, 0, 1):  # the batch whose paths come last comes first
        some = files.filter(F.col("batch") == batch)
        page = some.select("path", "size", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page_no"))
        pair = lambda name, n: F.struct(name.alias("feature"), n.cast("long").alias("n"))
        found = F.array(pair(F.concat(F.lit("size:"), F.floor(F.col("size") / 5000)), F.lit(1)), pair(F.concat(F.lit("length:"), F.col("size") % 13), F.col("page_no")), pair(F.concat(F.lit("operator:"), (F.col("size") + F.col("page_no")) % 11), F.col("size")))
        features = page.select("path", "page_no", F.explode(found).alias("f")).select("path", "page_no", "f.*")
        merging.add(state, str(batch), some.select("path", "sha256", "pages", F.lit(None).cast("string").alias("error")), features)
    return state


@query(
    f"""WITH {_FILES}, c AS (SELECT feature, count(DISTINCT path) AS documents, count(DISTINCT (path, page_no)) AS pages, sum(n)::BIGINT AS occurrences FROM f GROUP BY feature),
    e AS (SELECT feature, path, page_no, row_number() OVER (PARTITION BY feature ORDER BY path, page_no) AS r FROM (SELECT DISTINCT feature, path, page_no FROM f)),
    x AS (SELECT feature, string_agg(path::BIGINT || ':' || page_no, ',' ORDER BY r) AS examples FROM e WHERE r <= 5 GROUP BY feature)
    SELECT feature, CASE WHEN feature LIKE 'operator:%' THEN 'unsupported' ELSE 'observed' END AS status, documents, pages, occurrences, examples FROM c JOIN x USING (feature) WHERE feature IS NOT NULL"""
)
def merged_census(spark, sf_dir):
    """The census of three batches, merged from their states; copies are found across batches."""
    found = merging.summary(spark, _census_state(spark, sf_dir))
    said = F.concat_ws(",", F.transform("examples", lambda e: F.concat_ws(":", e["file"].cast("long").cast("string"), e["page"].cast("string"))))
    return found.select("feature", "status", "documents", "pages", "occurrences", said.alias("examples"))


@query(f"WITH {_FILES} SELECT split_part(feature, ':', 1) AS kind, count(DISTINCT path) AS documents FROM f WHERE feature NOT IN ('operator:0', 'operator:1', 'operator:2', 'operator:3', 'operator:4', 'operator:5', 'length:0') GROUP BY kind")
def documents_by_kind(spark, sf_dir):
    """In how many documents features of each kind occur, by joining bitmaps."""
    left_out = [*(f"operator:{i}" for i in range(6)), "length:0"]
    kind = F.when(~F.col("feature").isin(left_out), F.substring_index("feature", ":", 1))
    return merging.documents_by(spark, _census_state(spark, sf_dir), kind, "kind").filter("kind is not null")


@query("SELECT o_orderkey AS obj_id, (o_custkey % 10)::INTEGER AS generation, o_orderstatus AS status, length(' << /Status /' || o_orderstatus || ' /Priority (' || o_orderpriority || ') >> ')::INTEGER AS bytes FROM orders")
def object_records(spark, sf_dir):
    """Orders as objects of large files, each written twice, read in splits of 32 kB; the last of each id holds."""
    path = scratch_path(spark, "objects")
    line = F.concat(F.format_string("%d 0 obj null endobj %d %d obj << /Status /", "o_orderkey", "o_orderkey", F.col("o_custkey") % 10), "o_orderstatus", F.lit(" /Priority ("), "o_orderpriority", F.lit(") >> endobj"))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    records.register(spark)
    found = records.last_objects(spark.read.format(records.NAME).option("split", 32 << 10).option("last", True).load(path))
    body = F.col("body").cast("string")
    return found.select("obj_id", "generation", F.regexp_extract(body, "/Status /(\\w+)", 1).alias("status"), F.length(body).alias("bytes"))
