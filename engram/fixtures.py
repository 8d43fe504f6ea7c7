"""The driver's tables as memory-graph tables (the rules are in FIXTURES.md), and the same rules as a SQL prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the time at which event tables are looked at.
EVENTS_AS_OF = "2024-02-01 00:00:00"


class Tables:
    """Graph tables over one folder; each is built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @staticmethod
    def brain(custkey: str) -> Column:
        return F.concat(F.lit("b"), (F.col(custkey) % 4).cast("string"))

    @staticmethod
    def key(prefix: str, column: str) -> Column:
        return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))

    def neurons(self) -> DataFrame:
        kinds = [("region", "r", "r_regionkey", "SPATIAL", "r_name"), ("nation", "n", "n_nationkey", "SPATIAL", "n_name"), ("customer", "c", "c_custkey", "ENTITY", "c_name"), ("supplier", "s", "s_suppkey", "ENTITY", "s_name"), ("part", "p", "p_partkey", "CONCEPT", "p_name")]
        out = None
        for table, prefix, key, kind, content in kinds:
            brain = self.brain(key) if table == "customer" else F.lit("b0")
            t = self.read(table).select(self.key(prefix, key).alias("id"), brain.alias("brain_id"), F.lit(kind).alias("type"), F.col(content).alias("content"))
            out = t if out is None else out.unionByName(t)
        return out

    def neuron_states(self) -> DataFrame:
        """id, brain_id, access_frequency, activation_level, decay_rate, created_day, last_day (days since 1970)."""
        o = self.read("orders").select(self.key("c", "o_custkey").alias("id"), F.col("o_orderdate").alias("t"))
        li = self.read("lineitem")
        p, s = (li.select(self.key(k, c).alias("id"), F.col("l_shipdate").alias("t")) for k, c in (("p", "l_partkey"), ("s", "l_suppkey")))
        used = o.union(p).union(s).groupBy("id").agg(F.count(F.lit(1)).alias("f"), F.min("t").alias("a"), F.max("t").alias("z"))
        most = used.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.max("f").alias("most"))
        n = self.neurons().withColumn("kind", F.substring("id", 1, 1)).join(used, "id", "left").join(F.broadcast(most), "kind", "left")  # at most three kinds
        f = F.coalesce("f", F.lit(0)).cast("long")
        return n.select("id", "brain_id", f.alias("access_frequency"), F.coalesce(f / F.col("most"), F.lit(0.0)).alias("activation_level"), F.lit(0.1).alias("decay_rate"), day("a").alias("created_day"), day("z").alias("last_day"))

    def first_parts(self) -> DataFrame:
        """o_orderkey, o_custkey, o_orderdate and the first part of each order with items."""
        li = self.read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("m"))
        return self.read("orders").join(li, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderdate", F.col("m.l_partkey").alias("part"))

    def synapses(self) -> DataFrame:
        """id, brain_id, source_id, target_id, type, weight, reinforced_count, last_day."""
        none = {"weight": F.lit(0.8), "n": F.lit(0).cast("long"), "last": F.lit(None).cast("int")}

        def edges(df, brain, a, kind, b, weight, n, last):
            return df.select(brain.alias("brain_id"), a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("type"), weight.alias("weight"), n.cast("long").alias("reinforced_count"), last.alias("last_day"))

        shared = F.lit("b0")
        c, s, n = self.read("customer"), self.read("supplier"), self.read("nation")
        out = edges(c, self.brain("c_custkey"), self.key("c", "c_custkey"), "AT_LOCATION", self.key("n", "c_nationkey"), none["weight"], none["n"], none["last"])
        out = out.union(edges(s, shared, self.key("s", "s_suppkey"), "AT_LOCATION", self.key("n", "s_nationkey"), none["weight"], none["n"], none["last"]))
        out = out.union(edges(n, shared, self.key("n", "n_nationkey"), "CONTAINS", self.key("r", "n_regionkey"), F.lit(0.9), none["n"], none["last"]))
        li = self.read("lineitem")
        bought = li.join(self.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_partkey")
        bought = bought.agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("t"))
        out = out.union(edges(bought, self.brain("o_custkey"), self.key("c", "o_custkey"), "INVOLVES", self.key("p", "l_partkey"), F.least(F.lit(1.0), F.col("q") / 50), F.col("n"), day("t")))
        sold = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("t"))
        out = out.union(edges(sold, shared, self.key("p", "l_partkey"), "CO_OCCURS", self.key("s", "l_suppkey"), F.least(F.lit(1.0), 0.2 + 0.1 * F.col("n")), F.col("n"), day("t")))
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        nxt = self.first_parts().withColumns({"b": F.lead("part").over(w), "t": F.lead("o_orderdate").over(w)}).filter("b is not null and b <> part")
        nxt = nxt.groupBy(F.col("part").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t"))
        strong = F.least(F.lit(1.0), 0.4 + 0.1 * F.col("n"))
        out = out.union(edges(nxt, shared, self.key("p", "a"), "LEADS_TO", self.key("p", "b"), strong, F.col("n"), day("t")))
        out = out.union(edges(nxt, shared, self.key("p", "b"), "CAUSED_BY", self.key("p", "a"), strong, F.col("n"), day("t")))
        return out.select(F.concat_ws("|", "source_id", "type", "target_id").alias("id"), *out.columns)

    def fibers(self) -> DataFrame:
        """id, brain_id, anchor, salience, conductivity, frequency, created_day, end_day, pinned, status, priority."""
        li = self.read("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last"))
        o = self.read("orders")
        most = o.agg(F.max("o_totalprice").alias("most"))
        t = o.crossJoin(F.broadcast(most)).join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")  # one row
        salience = F.col("o_totalprice") / F.col("most")
        return t.select(
            self.key("f", "o_orderkey").alias("id"), self.brain("o_custkey").alias("brain_id"), self.key("c", "o_custkey").alias("anchor"), salience.alias("salience"), (0.5 + 0.5 * salience).alias("conductivity"),
            F.coalesce("n", F.lit(0)).cast("long").alias("frequency"), day("o_orderdate").alias("created_day"), F.greatest(day("o_orderdate"), day("last")).alias("end_day"),
            (F.col("o_orderkey") % 50 == 0).alias("pinned"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        )

    def fiber_neurons(self) -> DataFrame:
        """fiber_id, brain_id, neuron_id: the customer and the distinct parts of each order."""
        o = self.read("orders").select("o_orderkey", "o_custkey")
        parts = self.read("lineitem").select("l_orderkey", "l_partkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        fiber, brain = self.key("f", "o_orderkey").alias("fiber_id"), self.brain("o_custkey").alias("brain_id")
        return parts.select(fiber, brain, self.key("p", "l_partkey").alias("neuron_id")).union(o.select(fiber, brain, self.key("c", "o_custkey").alias("neuron_id")))

    def fiber_tags(self) -> DataFrame:
        """fiber_id, brain_id, tag, origin (agent: facets, auto: topics), distinct."""
        o = self.read("orders").join(self.read("customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
        fiber, brain = self.key("f", "o_orderkey").alias("fiber_id"), self.brain("o_custkey").alias("brain_id")
        items = self.read("lineitem").select("l_orderkey", "l_partkey").distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        parts = items.join(self.read("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
        tag = lambda df, c, origin: df.select(fiber, brain, c.alias("tag"), F.lit(origin).alias("origin"))
        out = tag(o, F.lower("o_orderpriority"), "agent").union(tag(o, F.lower("c_mktsegment"), "agent")).union(tag(parts, F.lower("p_brand"), "agent"))
        return out.union(tag(items, F.concat(F.lit("k"), F.floor(F.col("l_partkey") / 2).cast("string")), "auto")).distinct()

    def typed_memories(self) -> DataFrame:
        """fiber_id, brain_id, memory_type, priority, tier, created_day, expires_day."""
        p = F.substring("priority", 1, 1)
        pick = lambda *x: F.when(p == "1", x[0]).when(p == "2", x[1]).when(p == "3", x[2]).when(p == "4", x[3]).otherwise(x[4])
        days = pick(F.lit(90), F.lit(30), F.lit(None), F.lit(7), F.lit(30))
        tier = F.when(F.col("status") == "F", "cold").when(F.col("status") == "O", "warm").otherwise("hot")
        return self.fibers().select(F.col("id").alias("fiber_id"), "brain_id", pick(*map(F.lit, ("decision", "error", "fact", "context", "todo"))).alias("memory_type"), pick(*map(F.lit, (9, 7, 5, 3, 1))).alias("priority"), tier.alias("tier"), "created_day", (F.col("created_day") + days).cast("int").alias("expires_day"), "pinned")

    def events(self) -> DataFrame:
        """id, session_id, action, at (seconds since 1970), at_us, success, duration_ms, server, task, day."""
        e = self.read("events")
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("action"), us.alias("at_us"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"), F.concat(F.lit("srv"), (F.col("user_id") % 3).cast("string")).alias("server"), F.concat(F.lit("task"), (F.get_json_object("props", "$.k").cast("int") % 10).cast("string")).alias("task"), day("ts").alias("day"))

    def order_as_of(self) -> int:
        """The day after the last order."""
        return self.read("orders").agg(F.max(day("o_orderdate"))).head()[0] + 1

    def co_activations(self, unit: str) -> DataFrame:
        """a, b (a < b), strength, day: pairs of brands or parts of one order."""
        li = self.read("lineitem")
        if unit == "brand":
            li = li.join(self.read("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
        key = F.col("p_brand") if unit == "brand" else self.key("p", "l_partkey")
        q = li.groupBy("l_orderkey", key.alias("k")).agg(F.sum("l_quantity").alias("q"))
        x, y = q.alias("x"), q.alias("y")
        pairs = x.join(y, (F.col("x.l_orderkey") == F.col("y.l_orderkey")) & (F.col("x.k") < F.col("y.k")))
        pairs = pairs.join(self.read("orders").select("o_orderkey", "o_orderdate"), F.col("x.l_orderkey") == F.col("o_orderkey"))
        return pairs.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.least(F.lit(1.0), F.least("x.q", "y.q") / 50).alias("strength"), day("o_orderdate").alias("day"))


def day(column: str) -> Column:
    """Days since 1970 of a timestamp."""
    return F.unix_date(F.col(column).cast("date")).cast("int")


_DAY = "datediff('day', DATE '1970-01-01', CAST({} AS DATE))"


def _day(x: str) -> str:
    return f"CAST({_DAY.format(x)} AS INTEGER)"


#: Common table expressions with the rules of Tables, for the oracles.
CTES = {
    "neurons": """SELECT 'r:' || r_regionkey AS id, 'b0' AS brain_id, 'SPATIAL' AS type, r_name AS content FROM region
        UNION ALL SELECT 'n:' || n_nationkey, 'b0', 'SPATIAL', n_name FROM nation
        UNION ALL SELECT 'c:' || c_custkey, 'b' || (c_custkey % 4), 'ENTITY', c_name FROM customer
        UNION ALL SELECT 's:' || s_suppkey, 'b0', 'ENTITY', s_name FROM supplier
        UNION ALL SELECT 'p:' || p_partkey, 'b0', 'CONCEPT', p_name FROM part""",
    "used": """SELECT id, count(*) AS f, min(t) AS a, max(t) AS z FROM (
        SELECT 'c:' || o_custkey AS id, o_orderdate AS t FROM orders UNION ALL SELECT 'p:' || l_partkey, l_shipdate FROM lineitem
        UNION ALL SELECT 's:' || l_suppkey, l_shipdate FROM lineitem) GROUP BY id""",
    "neuron_states": f"""SELECT n.id, n.brain_id, CAST(coalesce(f, 0) AS BIGINT) AS access_frequency, coalesce(f / m.most, 0.0) AS activation_level,
        0.1::DOUBLE AS decay_rate, {_day('a')} AS created_day, {_day('z')} AS last_day
        FROM neurons n LEFT JOIN used USING (id) LEFT JOIN (SELECT left(id, 1) AS kind, max(f) AS most FROM used GROUP BY 1) m ON m.kind = left(n.id, 1)""",
    "first_parts": """SELECT o_orderkey, o_custkey, o_orderdate, part FROM orders JOIN (SELECT l_orderkey, l_partkey AS part,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) x ON l_orderkey = o_orderkey AND r = 1""",
    "leads": """SELECT part AS a, b, count(*) AS n, max(t) AS t FROM (SELECT part, lead(part) OVER w AS b, lead(o_orderdate) OVER w AS t FROM first_parts
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE b IS NOT NULL AND b <> part GROUP BY part, b""",
    "synapses": f"""SELECT source_id || '|' || type || '|' || target_id AS id, * FROM (
        SELECT 'b' || (c_custkey % 4) AS brain_id, 'c:' || c_custkey AS source_id, 'n:' || c_nationkey AS target_id, 'AT_LOCATION' AS type, 0.8::DOUBLE AS weight, 0::BIGINT AS reinforced_count, NULL::INTEGER AS last_day FROM customer
        UNION ALL SELECT 'b0', 's:' || s_suppkey, 'n:' || s_nationkey, 'AT_LOCATION', 0.8, 0, NULL FROM supplier
        UNION ALL SELECT 'b0', 'n:' || n_nationkey, 'r:' || n_regionkey, 'CONTAINS', 0.9, 0, NULL FROM nation
        UNION ALL SELECT 'b' || (o_custkey % 4), 'c:' || o_custkey, 'p:' || l_partkey, 'INVOLVES', least(1.0, sum(l_quantity) / 50), count(*), {_day('max(l_shipdate)')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
        UNION ALL SELECT 'b0', 'p:' || l_partkey, 's:' || l_suppkey, 'CO_OCCURS', least(1.0, 0.2::DOUBLE + 0.1::DOUBLE * count(*)), count(*), {_day('max(l_shipdate)')} FROM lineitem GROUP BY l_partkey, l_suppkey
        UNION ALL SELECT 'b0', 'p:' || a, 'p:' || b, 'LEADS_TO', least(1.0, 0.4::DOUBLE + 0.1::DOUBLE * n), n, {_day('t')} FROM leads
        UNION ALL SELECT 'b0', 'p:' || b, 'p:' || a, 'CAUSED_BY', least(1.0, 0.4::DOUBLE + 0.1::DOUBLE * n), n, {_day('t')} FROM leads)""",
    "fibers": f"""SELECT 'f:' || o_orderkey AS id, 'b' || (o_custkey % 4) AS brain_id, 'c:' || o_custkey AS anchor, o_totalprice / most AS salience, 0.5::DOUBLE + 0.5::DOUBLE * (o_totalprice / most) AS conductivity,
        CAST(coalesce(n, 0) AS BIGINT) AS frequency, {_day('o_orderdate')} AS created_day, greatest({_day('o_orderdate')}, {_day('last')}) AS end_day, o_orderkey % 50 = 0 AS pinned, o_orderstatus AS status, o_orderpriority AS priority
        FROM orders CROSS JOIN (SELECT max(o_totalprice) AS most FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "fiber_neurons": """SELECT 'f:' || o_orderkey AS fiber_id, 'b' || (o_custkey % 4) AS brain_id, 'c:' || o_custkey AS neuron_id FROM orders
        UNION ALL SELECT DISTINCT 'f:' || o_orderkey, 'b' || (o_custkey % 4), 'p:' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fiber_tags": """SELECT 'f:' || o_orderkey AS fiber_id, 'b' || (o_custkey % 4) AS brain_id, lower(o_orderpriority) AS tag, 'agent' AS origin FROM orders JOIN customer ON c_custkey = o_custkey
        UNION SELECT 'f:' || o_orderkey, 'b' || (o_custkey % 4), lower(c_mktsegment), 'agent' FROM orders JOIN customer ON c_custkey = o_custkey
        UNION SELECT 'f:' || o_orderkey, 'b' || (o_custkey % 4), lower(p_brand), 'agent' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
        UNION SELECT 'f:' || o_orderkey, 'b' || (o_custkey % 4), 'k' || (l_partkey // 2), 'auto' FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey""",
    "typed_memories": """SELECT id AS fiber_id, brain_id, CASE left(priority, 1) WHEN '1' THEN 'decision' WHEN '2' THEN 'error' WHEN '3' THEN 'fact' WHEN '4' THEN 'context' ELSE 'todo' END AS memory_type,
        CAST(CASE left(priority, 1) WHEN '1' THEN 9 WHEN '2' THEN 7 WHEN '3' THEN 5 WHEN '4' THEN 3 ELSE 1 END AS INTEGER) AS priority, CASE status WHEN 'F' THEN 'cold' WHEN 'O' THEN 'warm' ELSE 'hot' END AS tier,
        created_day, CAST(created_day + CASE left(priority, 1) WHEN '1' THEN 90 WHEN '2' THEN 30 WHEN '3' THEN NULL WHEN '4' THEN 7 ELSE 30 END AS INTEGER) AS expires_day, pinned FROM fibers""",
    "acts": f"""SELECT event_id AS id, user_id AS session_id, event_type AS action, epoch_us(ts) AS at_us, event_type <> 'error' AS success, value AS duration_ms, 'srv' || (user_id % 3) AS server,
        'task' || (CAST(props ->> '$.k' AS INTEGER) % 10) AS task, {_day('ts')} AS day FROM events""",
    "order_as_of": f"SELECT CAST(max({_day('o_orderdate')}) + 1 AS INTEGER) AS as_of FROM orders",
    "brand_pairs": f"""SELECT x.k AS a, y.k AS b, least(1.0, least(x.q, y.q) / 50) AS strength, {_day('o_orderdate')} AS day
        FROM (SELECT l_orderkey, p_brand AS k, sum(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) x
        JOIN (SELECT l_orderkey, p_brand AS k, sum(l_quantity) AS q FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) y ON x.l_orderkey = y.l_orderkey AND x.k < y.k JOIN orders ON o_orderkey = x.l_orderkey""",
    "part_pairs": f"""SELECT x.k AS a, y.k AS b, least(1.0, least(x.q, y.q) / 50) AS strength, {_day('o_orderdate')} AS day
        FROM (SELECT l_orderkey, 'p:' || l_partkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) x
        JOIN (SELECT l_orderkey, 'p:' || l_partkey AS k, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) y ON x.l_orderkey = y.l_orderkey AND x.k < y.k JOIN orders ON o_orderkey = x.l_orderkey""",
}
PREFIX = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in CTES.items())


def oracle(body: str, more: str = "") -> str:
    """A statement over the graph tables; more: further common table expressions."""
    return f"{PREFIX}{',' + chr(10) + more if more else ''}\n{body}"
