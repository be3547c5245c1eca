"""The queries on the engine's own operators and their SQL, by name: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..session import Session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers f(load) as a query; load gives a table as a dataset."""

    def registered(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session = Session(spark)
            out = f(lambda name: session.table(f"{sf_dir}/{name}.parquet"), session)
            return out.df if isinstance(out, Dataset) else out

        QUERIES[f.__name__] = run
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return registered


def cents(c: str):
    """A double in whole cents: sums of these don't depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


_CENTS = "CAST(round({} * 100) AS BIGINT)"


def one_row(session: Session, **values) -> DataFrame:
    return session.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) or v is None else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))


@query(
    """
SELECT l_returnflag, l_linestatus, count(*) AS n_rows, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
"""
)
def flagship_revenue_by_flag(load, session):
    """Rows and revenue, in whole cents, by return flag and line status."""
    lines = load("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    lines = lines.map(flag=F.struct("l_returnflag", "l_linestatus"), cents=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long"))
    return lines.combine_by_key(n_rows=F.count(F.lit(1)), revenue_cents=F.sum("cents")).map("flag.l_returnflag", "flag.l_linestatus", "n_rows", "revenue_cents")


@query("SELECT i::BIGINT AS id FROM range(0, 100, 4) t(i)")
def op_range(load, session):
    return session.range(0, 100, 4)


@query("SELECT (10 - i * 0.5)::DOUBLE AS id FROM range(0, 20) t(i)")
def op_range_down(load, session):
    return session.range(10, 0, -0.5)


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL), (NULL, 'd')) t(k, v)")
def op_parallelize(load, session):
    return session.parallelize([(1, "a"), (2, "b"), (3, None), (None, "d")], "k long, v string")


@query("SELECT 1::BIGINT AS k, 'a' AS v WHERE false")
def op_empty(load, session):
    return session.empty("k long, v string")


@query("SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents FROM lineitem")
def op_map(load, session):
    return load("lineitem").map("l_orderkey", "l_linenumber", cents=F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_returnflag = 'R'")
def op_filter(load, session):
    return load("lineitem").filter((F.col("l_quantity") < 5) & (F.col("l_returnflag") == "R")).map("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY word")
def op_flat_map(load, session):
    return load("conversations").flat_map(F.split("text", " "), "word").combine_by_key(n=F.count(F.lit(1)))


@query("SELECT upper(c_name) AS name, c_custkey * 2 AS twice FROM customer")
def op_map_function(load, session):
    """A Python function over rows."""
    return load("customer").map("c_custkey", "c_name").map_with(lambda r: (r["c_name"].upper(), r["c_custkey"] * 2), "name string, twice long")


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def op_map_partitions(load, session):
    parts = load("orders").map("o_custkey").map_partitions_with(lambda rows: [(len(rows), sum(r["o_custkey"] for r in rows))], "n long, total long")
    return parts.df.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("SELECT 7 AS n_partitions, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def op_glom(load, session):
    parts = load("orders").map("o_orderkey").repartition(7).glom("keys")
    total = F.sum(F.aggregate("keys", F.lit(0).cast("long"), lambda a, x: a + x))
    return parts.df.agg(F.count(F.lit(1)).cast("int").alias("n_partitions"), F.sum(F.size("keys")).alias("n_rows"), total.alias("total"))


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem UNION ALL SELECT o_orderkey FROM orders")
def op_union(load, session):
    orders = load("orders").map(k=F.col("o_orderkey"))
    return session.union(orders, load("lineitem").map(k=F.col("l_orderkey")), orders)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def op_distinct(load, session):
    return load("part").map("p_brand", "p_type").distinct()


@query("SELECT count(*) AS n FROM lineitem")
def op_count(load, session):
    return one_row(session, n=load("lineitem").count())


@query("SELECT max(l_extendedprice) AS most, min(l_extendedprice) AS least FROM lineitem")
def op_max_min(load, session):
    prices = load("lineitem").map("l_extendedprice")
    return one_row(session, most=prices.max()[0], least=prices.min()[0])


@query(
    """
SELECT (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 1) AS richest, (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 1) AS poorest
"""
)
def op_max_min_by_key(load, session):
    """The last of equal ones, in the order of the key."""
    customers = load("customer").map("c_custkey", "c_acctbal").sort_by("c_custkey")
    return one_row(session, richest=customers.max("c_acctbal")["c_custkey"], poorest=customers.min("c_acctbal")["c_custkey"])


@query(f"SELECT CAST(sum({_CENTS.format('o_totalprice')}) AS BIGINT) AS total FROM orders")
def op_reduce(load, session):
    return one_row(session, total=load("orders").reduce(F.sum(cents("o_totalprice"))))


@query("SELECT bit_xor(o_custkey) AS x FROM orders")
def op_reduce_function(load, session):
    """A Python function folds the rows, partition by partition."""
    return one_row(session, x=load("orders").map("o_custkey").reduce_with(lambda a, b: {"o_custkey": a["o_custkey"] ^ b["o_custkey"]})["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def op_take(load, session):
    rows = load("orders").map("o_orderkey", "o_custkey", "o_totalprice").sort_by("o_orderkey").sort_by("o_totalprice", ascending=False).take(30)
    return session.spark.createDataFrame([(r["o_orderkey"], r["o_custkey"]) for r in rows], "o_orderkey long, o_custkey long")


@query(f"SELECT o_custkey, count(*) AS n, CAST(sum({_CENTS.format('o_totalprice')}) AS BIGINT) // count(*) AS mean_cents FROM orders GROUP BY 1")
def op_combine_by_key(load, session):
    sums = load("orders").map("o_custkey", cents=cents("o_totalprice")).combine_by_key(n=F.count(F.lit(1)), total=F.sum("cents"))
    return sums.map("o_custkey", "n", mean_cents=F.expr("total div n"))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS orders FROM orders GROUP BY 1")
def op_combine_list(load, session):
    return load("orders").map("o_custkey", "o_orderkey").combine_by_key(orders=F.array_sort(F.collect_list("o_orderkey")))


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS priorities FROM orders GROUP BY 1")
def op_combine_set(load, session):
    return load("orders").map("o_custkey", "o_orderpriority").combine_by_key(priorities=F.array_sort(F.collect_set("o_orderpriority")))


@query("SELECT user_id, count(DISTINCT event_type) AS n_types, max(event_id) AS latest FROM events GROUP BY 1")
def op_combine_function(load, session):
    """Combiners that are Python objects: a set and a number."""
    pairs = load("events").map("user_id", "event_type", "event_id")
    return pairs.combine_by_key_with(
        lambda v: ({v["event_type"]}, v["event_id"]),
        lambda c, v: (c[0] | {v["event_type"]}, max(c[1], v["event_id"])),
        lambda a, b: (a[0] | b[0], max(a[1], b[1])),
        "n_types long, latest long",
        lambda c: (len(c[0]), c[1]),
    )


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def op_reduce_by_key(load, session):
    return load("events").map("event_type", n=F.lit(1).cast("long")).reduce_by_key("sum")


@query("SELECT l_orderkey, max(l_partkey) AS part FROM lineitem GROUP BY 1")
def op_reduce_by_key_function(load, session):
    return load("lineitem").map("l_orderkey", part=F.col("l_partkey")).reduce_by_key_with(max)


@query(
    """
WITH o AS (SELECT o_custkey AS k, list_sort(list(o_orderkey)) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
c AS (SELECT c_custkey AS k, list(c_name) AS names FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT k, coalesce(names, []) AS names, coalesce(orders, []) AS orders FROM c FULL JOIN o USING (k)
"""
)
def op_cogroup(load, session):
    customers = load("customer").filter(F.col("c_acctbal") > 0).map(k=F.col("c_custkey"), name=F.col("c_name"))
    orders = load("orders").filter(F.col("o_orderstatus") == "F").map(k=F.col("o_custkey"), order=F.col("o_orderkey")).sort_by("order")
    return customers.cogroup(orders, names=["names", "orders"])


@query(
    """
WITH a AS (SELECT n_nationkey AS k, count(*) AS n, sum(n_regionkey) AS t FROM nation GROUP BY 1),
b AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_custkey) AS t FROM customer WHERE c_nationkey < 20 GROUP BY 1),
c AS (SELECT s_nationkey AS k, count(*) AS n, sum(s_suppkey) AS t FROM supplier WHERE s_nationkey > 3 GROUP BY 1)
SELECT k, coalesce(a.n, 0)::INT AS n_nations, coalesce(b.n, 0)::INT AS n_customers, coalesce(b.t, 0)::BIGINT AS customers, coalesce(c.n, 0)::INT AS n_suppliers, coalesce(c.t, 0)::BIGINT AS suppliers
FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)
"""
)
def op_group_with(load, session):
    nations = load("nation").map(k=F.col("n_nationkey"), v=F.col("n_name"))
    customers = load("customer").filter("c_nationkey < 20").map(k=F.col("c_nationkey"), v=F.col("c_custkey"))
    suppliers = load("supplier").filter("s_nationkey > 3").map(k=F.col("s_nationkey"), v=F.col("s_suppkey"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    out = nations.group_with(customers, suppliers, names=["a", "b", "c"])
    return out.map("k", n_nations=F.size("a"), n_customers=F.size("b"), customers=total("b"), n_suppliers=F.size("c"), suppliers=total("c"))


def _documents_labels(load):
    docs = load("documents").filter(F.col("lang") != "en").map(k=F.col("doc_id"), lang=F.col("lang"))
    return docs, load("labels").filter(F.col("quality") == 1).map(k=F.col("doc_id"), toxic=F.col("toxic"))


_SIDES = "WITH d AS (SELECT doc_id AS k, lang FROM documents WHERE lang <> 'en'), b AS (SELECT doc_id AS k, toxic FROM labels WHERE quality = 1) "


@query(_SIDES + "SELECT k, lang, toxic FROM d JOIN b USING (k)")
def op_join(load, session):
    docs, labels = _documents_labels(load)
    return docs.join(labels)


@query(_SIDES + "SELECT k, lang, toxic FROM d LEFT JOIN b USING (k)")
def op_left_join(load, session):
    docs, labels = _documents_labels(load)
    return docs.left_outer_join(labels)


@query(_SIDES + "SELECT k, lang, toxic FROM d RIGHT JOIN b USING (k)")
def op_right_join(load, session):
    docs, labels = _documents_labels(load)
    return docs.right_outer_join(labels)


@query(_SIDES + "SELECT k, lang, toxic FROM d FULL JOIN b USING (k)")
def op_full_join(load, session):
    docs, labels = _documents_labels(load)
    return docs.full_outer_join(labels)


@query(
    """
WITH a AS (SELECT nullif(s_nationkey, 7) AS k, s_suppkey FROM supplier), b AS (SELECT nullif(n_nationkey, 7) AS k, n_name FROM nation)
SELECT b.k, s_suppkey, n_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k
"""
)
def op_join_null_key(load, session):
    suppliers = load("supplier").map("s_suppkey", k=F.nullif(F.col("s_nationkey"), F.lit(7))).map("k", "s_suppkey")
    return suppliers.join(load("nation").map("n_name", k=F.nullif(F.col("n_nationkey"), F.lit(7))).map("k", "n_name"))


@query("SELECT (row_number() OVER (ORDER BY r_name))::BIGINT AS place, r_name FROM region UNION ALL SELECT (5 + row_number() OVER (ORDER BY n_name))::BIGINT, n_name FROM nation")
def op_sort(load, session):
    """Sorts within a union stay one after the other; the places are those of the collected rows."""
    names = load("region").map("r_name").sort().union(load("nation").map(r_name=F.col("n_name")).sort())
    return names.with_places().map("r_name", place=F.col("place") + 1)


@query("SELECT (row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey))::BIGINT AS place, c_custkey FROM customer")
def op_sort_by_stable(load, session):
    """Downwards by segment: customers of one segment keep the order by key that they had."""
    rows = load("customer").map("c_custkey", "c_mktsegment").sort_by("c_custkey").sort_by("c_mktsegment", ascending=False, partitions=6)
    return rows.with_places().map("c_custkey", place=F.col("place") + 1)


@query("SELECT (o_custkey % 3)::INT AS part, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def op_partition_by(load, session):
    placed = load("orders").map("o_custkey", "o_orderkey").partition_by(3, F.col("o_custkey") % 3)
    return placed.df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total, min(o_orderkey) AS least, max(o_orderkey) AS most, 16 AS n_partitions FROM orders")
def op_repartition(load, session):
    dealt = load("orders").map("o_orderkey").repartition(16).df.withColumn("part", F.spark_partition_id())
    keys = F.col("o_orderkey")
    return dealt.agg(F.count(keys).alias("n"), F.sum(keys).alias("total"), F.min(keys).alias("least"), F.max(keys).alias("most"), F.count_distinct("part").cast("int").alias("n_partitions"))


@query("SELECT i::INT AS part, 2000::BIGINT AS n, (i * 2000)::BIGINT AS least, (i * 2000 + 1999)::BIGINT AS most FROM range(0, 5) t(i)")
def op_rebalance(load, session):
    """From four partitions to five, in order."""
    rows = session.range(10_000).rebalance(5)
    return rows.df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


@query("SELECT count(*) AS n, max(p_retailprice) AS most FROM part")
def op_persist(load, session):
    parts = load("part").map("p_retailprice").persist()
    out = one_row(session, n=parts.count(), most=parts.max()[0])
    parts.unpersist()
    return out


@query("SELECT 100 AS n_tasks, 78498 AS n_primes")
def op_execute_primes(load, session):
    """A hundred tasks each count the primes among ten thousand numbers."""

    def task(i: int) -> int:
        low, high = i * 10_000, (i + 1) * 10_000
        sieve = bytearray([1]) * 10_000
        for p in range(2, 1000):
            first = max(p * p, -(-low // p) * p)
            sieve[first - low :: p] = bytes(len(range(first, high, p)))
        return sum(sieve) - 2 * (i == 0)

    return session.spark.createDataFrame([session.execute(100, task, lambda counts: (len(counts), sum(counts)))], "n_tasks int, n_primes int")


def _saved(session: Session) -> str:
    """A folder for a query's files: in the checkpoint folder the cluster shares. Where all executors are threads of this process one of our own serves if none is named."""
    import re
    import tempfile
    import uuid

    named = session.spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", session.spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return f"{named or tempfile.mkdtemp(prefix='brindle-')}/{uuid.uuid4().hex}"


@query("SELECT c_mktsegment, count(*) AS n, min(c_name) AS first FROM customer GROUP BY 1")
def op_text_roundtrip(load, session):
    """Lines written with gzip and read again."""
    at = _saved(session)
    load("customer").map(line=F.concat_ws("|", "c_mktsegment", "c_name")).save_as_text_file(at, compression="gzip")
    parts = F.split("value", r"\|")
    return session.text_file(at).map(c_mktsegment=parts[0], name=parts[1]).combine_by_key(n=F.count(F.lit(1)), first=F.min("name"))


@query("SELECT count(*) AS n, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS n_bytes FROM nation")
def op_whole_text(load, session):
    at = _saved(session)
    load("nation").map("n_name").save_as_text_file(at)
    texts = session.whole_text_files(at).df
    lines = F.size(F.split("value", "\n")) - 1
    return texts.agg(F.sum(lines).alias("n"), F.sum(F.octet_length("value")).alias("n_bytes"))


@query("SELECT 1::BIGINT AS n_files, CAST(sum(strlen(r_name) + 1) AS BIGINT) AS n_bytes FROM region")
def op_binary(load, session):
    at = _saved(session)
    Dataset(session, load("region").map("r_name").df.coalesce(1)).save_as_text_file(at)
    return session.binary_files(at).df.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def op_combine_by_key_partitions(load, session):
    """Dealt by an expression of the key: each key lies in the partition that it names, or the query fails."""
    out = load("orders").map("o_custkey").combine_by_key(partitions=5, partition_of=F.col("o_custkey") % 5, n=F.count(F.lit(1)))
    wrong = F.spark_partition_id() != F.col("o_custkey") % 5
    return out.df.select(F.when(wrong, F.raise_error("a key lies elsewhere")).otherwise(F.col("o_custkey")).cast("long").alias("o_custkey"), "n")


@query("SELECT l_linenumber, max(l_orderkey) AS latest FROM lineitem GROUP BY 1")
def op_reduce_by_key_partitions(load, session):
    return load("lineitem").map("l_linenumber", latest=F.col("l_orderkey")).reduce_by_key_with(max, partitions=3, partition_of=F.col("l_linenumber") % 3)


@query("SELECT n_regionkey, CAST(product(n_nationkey + 1) AS BIGINT) AS x FROM nation GROUP BY 1")
def op_reduce_by_key_product(load, session):
    return load("nation").map("n_regionkey", x=(F.col("n_nationkey") + 1).cast("long")).reduce_by_key("product")


@query(_SIDES + "SELECT k, lang, toxic FROM d JOIN b USING (k)")
def op_join_partitions(load, session):
    docs, labels = _documents_labels(load)
    return docs.join(labels, partitions=4, partition_of=F.col("k") % 4)


@query("SELECT (SELECT max(l_extendedprice) FROM lineitem) AS most, (SELECT min(l_extendedprice) FROM lineitem) AS least")
def op_max_min_function(load, session):
    """By a comparator in Python, partition by partition."""
    prices, compare = load("lineitem").map("l_extendedprice"), lambda a, b: a["l_extendedprice"] - b["l_extendedprice"]
    return one_row(session, most=prices.max_with(compare)["l_extendedprice"], least=prices.min_with(compare)["l_extendedprice"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 7 = 3")
def op_filter_function(load, session):
    """A function that reads its surroundings: a number and another function."""
    seven, left = 7, lambda x: x % seven
    return load("customer").map("c_custkey").filter_with(lambda r: left(r["c_custkey"]) == 3)


@query("SELECT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> ''")
def op_flat_map_function(load, session):
    return load("part").map("p_name").flat_map_with(lambda r: ((w,) for w in r["p_name"].split(" ") if w), "word string")


@query("SELECT r_name AS name, 2 AS n_files, true AS by_connector FROM region")
def op_file_loader(load, session):
    """Written and read by a registered connector: a file for each partition, and the marks of a finished folder."""
    from ..sources.loaders import SharedFolder

    at = _saved(session).removeprefix("file://")
    session.register_file_loader(SharedFolder())
    load("region").map("r_name").rebalance(2).save_as_text_file(at)
    loader = session.get_file_loader(at)
    files = [f for f in loader.list_files(at) if f.rsplit("/", 1)[-1].startswith("part-")]
    # region has fewer rows than a line has room for: the files are listed here, their lines are read by the executors
    lines = session.union(*[session.text_file(f) for f in files])
    return lines.map(name=F.col("value")).map("name", n_files=F.lit(len(files)), by_connector=F.lit(isinstance(loader, SharedFolder)))


@query("SELECT 6 AS dealt, 9 AS ranged, 4 AS usual")
def op_num_partitions(load, session):
    rows = session.range(1000)
    out = (rows.repartition(6).num_partitions, session.range(0, 1000, partitions=9).num_partitions, rows.num_partitions)
    return session.spark.createDataFrame([out], "dealt int, ranged int, usual int")


@query("SELECT count(*) AS n, true AS kept, false AS kept_after, false AS kept_after_action FROM supplier")
def op_unpersist(load, session):
    """Kept until it is dropped: at once, or by the end of the first action."""
    rows = load("supplier").map("s_suppkey").persist()
    n, kept = rows.count(), rows.df.is_cached or rows._df.is_cached
    after = rows.unpersist()._df.storageLevel.useDisk
    rows.persist().auto_unpersist().count()
    return session.spark.createDataFrame([(n, kept, after, rows._df.storageLevel.useDisk)], "n long, kept boolean, kept_after boolean, kept_after_action boolean")


@query("SELECT 4 AS default_partitions, 'disk' AS default_storage, true AS same_spark")
def op_session(load, session):
    """A session on the one that runs, and its options."""
    from ..session import create_session

    own = create_session()
    options = own.options
    return session.spark.createDataFrame([(options["default_partitions"], options["default_storage"], own.spark is session.spark)], "default_partitions int, default_storage string, same_spark boolean")
