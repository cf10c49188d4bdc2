"""The engine's own queries on the driver's tables: each runs one of its operators through the engine's interface."""

from __future__ import annotations

import asyncio
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom import Settings, flat_map, gather_actions, gather_tasks, indexed, load_dataset, map_frame, map_or_first_error, map_tasks, save_dataset, scope, session, task, workflow, zip_frames
from taskloom.errors import TaskError
from taskloom.functions import duration_column, template_column
from taskloom.operators.compose import first_error, table_function
from taskloom.plans import MISS, CacheStore, EventLog, value_key
from taskloom.scope import current_task
from taskloom.sources import DatasetStore, Storage
from taskloom.streaming import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder; on a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/taskloom-{uuid.uuid4().hex}"


# Tasks


@task(mode="table")
def square_all(rows: DataFrame) -> DataFrame:
    return rows.select((F.col("l_quantity") * F.col("l_quantity")).alias("squared"))


@task(mode="table")
def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum("squared").alias("total"))


@task(mode="column")
def double(x: float) -> float:
    return x * 2


@task(mode="column")
def to_string(x: int) -> str:
    return x.cast("string")


@task(mode="column")
def maybe_none(x: float) -> float | None:
    return F.when(x > 0, x)


@task
def double_rows(x: int) -> int:
    return x * 2


@task(mode="column")
def add(x: int, y: int) -> int:
    return x + y


@task(mode="column")
def count_up(n: int) -> Iterator[int]:
    n = n.cast("long")
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


@task
def count_up_rows(n: int) -> Iterator[int]:
    yield from range(n)


@task
def double_each(xs: list[int]) -> list[int]:
    """A map inside of a map: it runs in place, whatever the strategy around it."""
    return map_tasks(double_rows, xs)


@task(retries=1)
def in_region(nation: int, region: int) -> int:
    if region == 0:
        raise ValueError(f"nation {nation} is in region 0")
    return region


@task(name="nation_{n}")
def named_nation(n: int) -> str:
    return current_task().name


@task(mode="column")
def fail_on_three(x: int) -> str | None:
    return F.when(x == 3, F.lit("three is bad"))


@task(mode="table")
def plus_ten(part: DataFrame) -> DataFrame:
    return part.withColumn("left", F.col("p_size") + 10)


@task(mode="table")
def times_ten(part: DataFrame) -> DataFrame:
    return part.withColumn("right", F.col("p_size") * 10)


@task(mode="table")
def fan_in(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", add(F.col("left"), F.col("right")).cast("long").alias("result"))


@workflow
def diamond(part: DataFrame) -> DataFrame:
    """Two branches from one root, as columns of one plan, and their sum."""
    return fan_in(times_ten(plus_ten(part)))


@workflow
def math(rows: DataFrame, x: str, y: str, factor: int = 2) -> DataFrame:
    return rows.select(((F.col(x) + F.col(y)) * factor).alias("result"))


# Queries


def sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    @workflow
    def run() -> DataFrame:
        squared = square_all(table(spark, sf_dir, "lineitem"))
        save_dataset("squared_values", squared, format="parquet")
        return total(load_dataset("squared_values", DataFrame, schema=squared.schema))

    with session(dataset_store=scratch(spark)):
        return run()


def task_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_frame(double, table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", "result")


def task_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_frame(to_string, table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "result")


def task_maybe_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_frame(maybe_none, table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey", "result")


def task_row_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_frame(double_rows, table(spark, sf_dir, "part"), "p_size").select("p_partkey", "result")


def map_zip_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = indexed(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    suppliers = indexed(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    return map_frame(add, zip_frames(customers, suppliers), "c_custkey", "s_suppkey").select("map_index", "result")


def map_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexed(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return rows.select(template_column("double[{map_index}]", {"map_index": F.col("map_index")}).alias("name"))


def map_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(F.lit(False))
    return map_frame(add, rows, F.col("o_orderkey"), F.lit(0)).select("result")


def map_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("map_index"), "p_size")
    return first_error(rows, fail_on_three(F.col("p_size")))


def map_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps inside of a map: the orders of each nation's customers, doubled."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list("c_custkey").alias("xs")).orderBy("c_nationkey").collect()
    found = map_tasks(double_each, [r["xs"] for r in rows], backend="distributed")
    return spark.createDataFrame([(r["c_nationkey"], len(xs), sum(xs)) for r, xs in zip(rows, found, strict=True)], "c_nationkey int, n long, result long")


def map_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task in column mode on the elements of arrays."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("xs"))

    @task(mode="column")
    def doubled_sum(xs: list[int]) -> int:
        return F.aggregate(F.transform(xs, double), F.lit(0).cast("long"), lambda a, x: a + x)

    return map_frame(doubled_sum, lists, "xs").select("l_orderkey", "result")


def gen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_map(count_up, table(spark, sf_dir, "part"), F.col("p_size") % 5).select("p_partkey", "value")


def gen_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = map_frame(count_up, table(spark, sf_dir, "part"), F.col("p_size") % 5, result="items")
    return made.select("p_partkey", F.array_join("items", ",").alias("value"))


def udtf_count_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of Python as a table function, beside each row."""
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 5).alias("n"))
    items = table_function(count_up_rows)
    return parts.lateralJoin(items(F.col("n").outer())).select("p_partkey", "value")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of Python, drained on the executors into a row for each item."""
    return flat_map(count_up_rows, table(spark, sf_dir, "part"), F.col("p_size") % 5).select("p_partkey", "iter_index", "value")


def stream_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of sync and async tasks, read item by item, and how often the hook saw one."""
    sizes = [r[0] for r in table(spark, sf_dir, "nation").select("n_regionkey").orderBy("n_nationkey").collect()]
    log = EventLog()

    @task
    async def count_up_async(n: int):
        for i in range(n):
            await asyncio.sleep(0)
            yield i

    async def drain(n: int) -> list[int]:
        return [x async for x in count_up_async(n)]

    with session(plugins=[log]):
        out = [(i, "sync", x) for i, n in enumerate(sizes) for x in count_up_rows(n)]
        out += [(i, "async", x) for i, n in enumerate(sizes) for x in asyncio.run(drain(n))]
    seen = log.frame(spark).where("event = 'node_iteration'").count()
    return spark.createDataFrame([(*r, seen) for r in out], "nation long, kind string, item long, iterations long")


def wf_diamond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diamond(table(spark, sf_dir, "part"))


def wf_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return math(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def cache_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each supplier; a key's first two digits are its folder."""
    keys = [r[0] for r in table(spark, sf_dir, "supplier").select(F.sha2(F.col("s_suppkey").cast("string"), 256)).collect()]
    store = CacheStore(scratch(spark))
    for k in keys:
        store.put(k, k)
    places = [(k.split("/")[0],) for k in store.storage.list_keys() if k.endswith(".meta.json")]
    return spark.createDataFrame(places, "shard string").groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that live ten seconds for each region number, looked up after 25; without a number they'd live for ever."""
    now = [1000.0]
    store = CacheStore(scratch(spark), clock=lambda: now[0])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").collect()
    for r in rows:
        store.put(f"{r.n_nationkey:08x}", r.n_nationkey, ttl=10 * r.n_regionkey if r.n_regionkey else None)
    now[0] += 25
    found = [(r.n_nationkey, "expired" if (value := store.get(f"{r.n_nationkey:08x}")) is MISS else "hit", -1 if value is MISS else value) for r in rows]
    left = len(store.keys())
    return spark.createDataFrame([(*f, left) for f in found], "n_nationkey int, status string, value int, entries long")


def cache_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call is served from the cache: the task runs once, and the hook hears of one hit."""
    runs, log = [], EventLog()

    @task(mode="table", cache=True)
    def by_status(orders: DataFrame) -> DataFrame:
        runs.append(1)
        return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))

    with session(cache_store=scratch(spark), plugins=[log]):
        by_status(table(spark, sf_dir, "orders"))
        found = by_status(table(spark, sf_dir, "orders"))
    hits = log.frame(spark).where("event = 'on_cache_hit'").count()
    return found.select("o_orderstatus", "n", F.lit(len(runs)).alias("runs"), F.lit(hits).alias("hits"))


def cache_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second entry of a key takes the place of the first, whose data go."""
    store = CacheStore(scratch(spark))
    for low in (0, 2):
        store.put("abc123", table(spark, sf_dir, "nation").where(F.col("n_regionkey") >= low))
    files = len([k for k in store.storage.list_keys() if k.endswith(".parquet")])
    return store.get("abc123").select("n_nationkey", F.lit(files).cast("long").alias("tables"))


def _round_trip(spark: SparkSession, sf_dir: str, name: str, fmt: str) -> DataFrame:
    rows = table(spark, sf_dir, name)
    with session(dataset_store=scratch(spark)):
        save_dataset(f"{name}.{fmt}", rows)
        return load_dataset(f"{name}.{fmt}", DataFrame, schema=rows.schema)


def dataset_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "nation", "parquet")


def dataset_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "nation", "orc")


def dataset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "nation", "json")


def dataset_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "nation", "csv")


def dataset_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of text out and in again."""
    lines = table(spark, sf_dir, "region").select(F.col("r_name").alias("value"))
    store = DatasetStore(scratch(spark))
    store.save("lines", lines, "text")
    return store.load("lines", DataFrame, "text")


def dataset_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of bytes, read back as a binary file."""
    store = DatasetStore(scratch(spark))
    store.save("blob.bin", b"\x00\x01taskloom")
    return spark.createDataFrame([(bytearray(store.load("blob.bin")),)], "content binary").select(F.hex("content").alias("content"))


def dataset_key_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's output under a key made of its inputs: a dataset for each status, each loaded by its key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")

    @task(mode="table", dataset="orders/{status}_{map_index}.parquet")
    def of_status(status: str) -> DataFrame:
        return orders.where(F.col("o_orderstatus") == status)

    store = DatasetStore(scratch(spark))
    with session(dataset_store=store):
        map_tasks(of_status, sorted(r[0] for r in orders.select("o_orderstatus").distinct().collect()))
    sizes = [(k, store.load(k, DataFrame).count()) for k in store.list_keys()]
    return spark.createDataFrame(sizes, "key string, n long")


def dataset_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, bytes and pickled values by key, told by their extension, and what was there before and after a deletion."""
    store = DatasetStore(scratch(spark), trust_pickle=True)
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]
    for i, name in enumerate(names):
        store.save(f"{i}.txt", name)
        store.save(f"{i}.bin", name.encode())
        store.save(f"{i}.pkl", {"name": name, "letters": set(name)})
    store.delete("0.txt")
    out = []
    for i, name in enumerate(names):
        pickled = store.load(f"{i}.pkl", dict)
        out.append((i, store.exists(f"{i}.txt"), store.load(f"{i}.bin").decode(), pickled["name"], len(pickled["letters"]), len(store.list_keys())))
        assert name == (store.load(f"{i}.txt") if i else name)
    return spark.createDataFrame(out, "n_nationkey long, has_text boolean, raw string, pickled string, letters long, keys long")


def format_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Page_"), F.col("page_id"), F.when(F.col("page_id") % 2 == 0, ".CSV").otherwise(".tar.GZ"))

    @task
    def hint(key: str) -> str | None:
        return Storage.format_hint(key)

    return map_frame(hint, table(spark, sf_dir, "pages"), name, result="ext").select("page_id", "ext")


def template_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = template_column("out_{lang}_{missing}.csv", {"lang": F.col("lang"), "source": F.col("source")})
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("k"))


def resolver_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which store and strategy a task finds: a call's own, the task's, the session's, that of the settings; a nation's bits tell which there are."""

    def one(n: int) -> tuple[int, str, str]:
        @task(dataset_store="task" if n & 2 else None, backend="threads" if n & 2 else None)
        def ask() -> tuple[str, str]:
            return scope.dataset_store("call" if n & 1 else None).base_path, scope.backend_name("distributed" if n & 1 else current_task().backend)

        with session(dataset_store="session" if n & 4 else None, backend="inline" if n & 4 else None, settings=Settings(dataset_store="settings", backend="sequential")):
            return n, *ask()

    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([one(k) for k in keys], "n_nationkey int, store string, backend string")


def canonical_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of sets, made by the executors: customers whose orders have the same priorities share one, in whatever order they came."""

    @task
    def key_of(xs: list[str]) -> str:
        return value_key(str, {"xs": set(xs)})

    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.shuffle(F.collect_set("o_orderpriority")).alias("xs"))
    keyed = map_frame(key_of, sets, "xs", result="key")
    v = F.array_join(F.array_sort("xs"), "|")
    return keyed.groupBy("key").agg(F.min(v).alias("v"), F.countDistinct(v).alias("kinds"), F.count(F.lit(1)).alias("n")).drop("key")


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows of a session that maps a task over all nations; those of region 0 fail, and fail again."""
    log = EventLog()
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    with session(plugins=[log]), contextlib.suppress(TaskError):
        map_tasks(in_region, [r.n_nationkey for r in rows], [r.n_regionkey for r in rows])
    return log.frame(spark)


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _watched(spark, sf_dir).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task_id").alias("tasks"))


def event_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the error hook was told, by element."""
    failed = _watched(spark, sf_dir).where("event = 'on_node_error'")
    return failed.select("map_index", "name", F.element_at("data", "error").alias("error"))


def event_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with the tasks that they were called in: a task for each region calls one for each of its nations."""
    log = EventLog()
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()

    @task(name="region_{region}")
    def nations_of(region: int) -> list[str]:
        return [named_nation(r.n_nationkey) for r in rows if r.n_regionkey == region]

    with session(plugins=[log]):
        for region in sorted({r.n_regionkey for r in rows}):
            nations_of(region)
    begun = log.frame(spark).where("event = 'before_node_execute'")
    parents = begun.select(F.col("task_id").alias("parent_id"), F.col("name").alias("parent"))
    return begun.join(parents, "parent_id", "left").select("name", "parent")


def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names filled in from inputs, and by the element of a map, as the task itself sees them."""
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    return spark.createDataFrame(list(enumerate(map_tasks(named_nation, keys, backend="threads"))), "map_index long, name string")


def gather_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coroutines at once in one event loop: all of them begin before the first ends."""
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    begun: list[int] = []

    @task
    async def wait_for_all(n: int) -> int:
        begun.append(n)
        while len(begun) < len(keys):
            await asyncio.sleep(0)
        return n * 2

    found = asyncio.run(gather_tasks(wait_for_all, keys))
    return spark.createDataFrame(list(enumerate(found)), "map_index long, result long")


def map_raises_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a map over rows, all run, and the error of the lowest index is the one that is raised."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("map_index"), "p_size")

    @task
    def not_seven(x: int) -> int:
        if x == 7:
            raise ValueError("seven is bad")
        return x

    try:
        map_or_first_error(not_seven, rows, "p_size")
        said = ""
    except TaskError as e:
        said = str(e)
    return spark.createDataFrame([(said,)], "error string")


def setting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of parts that a distributed map keeps to: executors tell the part that they ran in."""
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]

    @task
    def part(n: int) -> int:
        return TaskContext.get().partitionId()

    with session(settings=Settings(max_partitions=2)):
        found = map_tasks(part, keys, backend="distributed")
    return spark.createDataFrame([(len(found), len(set(found)))], "n long, parts long")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = windowed_counts(table(spark, sf_dir, "events"), "ts", "1 day", "event_type")
    return daily.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def fmt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", duration_column(F.col("value")).alias("t"))


def retry_flaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fails twice, then counts."""
    tries: list[int] = []

    @task(retries=2)
    def flaky() -> int:
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("not yet")
        return table(spark, sf_dir, "nation").count()

    return spark.createDataFrame([(flaky(), len(tries))], "n long, attempts int")


def gather_concurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three tables by actions side by side."""
    names = ["region", "nation", "supplier"]
    counts = gather_actions(*[lambda n=n: table(spark, sf_dir, n).count() for n in names])
    return spark.createDataFrame(list(zip(names, counts, strict=True)), "name string, n long")


def map_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function on the elements of a list as one Spark job."""
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    found = map_tasks(double_rows, keys, backend="distributed")
    return spark.createDataFrame(list(enumerate(found)), "map_index long, result long")


def map_async(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coroutines over rows."""

    @task
    async def async_double(x: int) -> int:
        await asyncio.sleep(0)
        return x * 2

    return map_frame(async_double, table(spark, sf_dir, "nation"), "n_nationkey").select("n_nationkey", "result")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        sum_of_squares, task_double, task_to_string, task_maybe_none, task_row_udf, task_names, map_zip_shortest, map_names, map_empty, map_first_error, map_raises_lowest, map_nested, map_arrays,
        map_distributed, map_async, gen_rows, gen_list, udtf_count_up, stream_rows, stream_call, wf_diamond, wf_math, cache_shards, cache_ttl, cache_hit, cache_replaced, dataset_parquet,
        dataset_orc, dataset_json, dataset_csv, dataset_text, dataset_raw, dataset_values, dataset_key_template, format_hint, template_resolve, resolver_chain, canonical_set, event_counts,
        event_payload, event_parent, event_windows, fmt_duration, retry_flaky, gather_concurrent, gather_async, setting_values,
    )
}

ORACLES: dict[str, str] = {
    "sum_of_squares": "SELECT sum(l_quantity * l_quantity) AS total FROM lineitem",
    "task_double": "SELECT o_orderkey, o_totalprice * 2 AS result FROM orders",
    "task_to_string": "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS result FROM customer",
    "task_maybe_none": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS result FROM customer",
    "task_row_udf": "SELECT p_partkey, CAST(p_size * 2 AS BIGINT) AS result FROM part",
    "map_zip_shortest": """
        WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS map_index, c_custkey FROM customer),
        b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS map_index, s_suppkey FROM supplier)
        SELECT map_index, c_custkey + s_suppkey AS result FROM a JOIN b USING (map_index)""",
    "map_names": "SELECT 'double[' || (row_number() OVER (ORDER BY c_custkey) - 1) || ']' AS name FROM customer",
    "map_empty": "SELECT o_orderkey AS result FROM orders WHERE false",
    "map_first_error": "SELECT 'three is bad' AS err, min(p_partkey) AS map_index FROM part WHERE p_size = 3",
    "map_nested": "SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey * 2) AS BIGINT) AS result FROM customer GROUP BY c_nationkey",
    "map_distributed": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS map_index, CAST(n_nationkey * 2 AS BIGINT) AS result FROM nation",
    "map_async": "SELECT n_nationkey, CAST(n_nationkey * 2 AS BIGINT) AS result FROM nation",
    "gen_rows": "SELECT p_partkey, unnest(range(p_size % 5)) AS value FROM part",
    "gen_list": "SELECT p_partkey, coalesce(array_to_string(range(p_size % 5), ','), '') AS value FROM part",
    "udtf_count_up": "SELECT p_partkey, unnest(range(p_size % 5)) AS value FROM part",
    "wf_diamond": "SELECT p_partkey, CAST((p_size + 10) + (p_size * 10) AS BIGINT) AS result FROM part",
    "wf_math": "SELECT (l_partkey + l_suppkey) * 2 AS result FROM lineitem",
    "cache_shards": "SELECT substr(sha256(CAST(s_suppkey AS VARCHAR)), 1, 2) AS shard, count(*) AS n FROM supplier GROUP BY 1",
    "cache_ttl": """
        WITH h AS (SELECT n_nationkey, n_regionkey = 0 OR 25 <= 10 * n_regionkey AS hit FROM nation)
        SELECT n_nationkey, CASE WHEN hit THEN 'hit' ELSE 'expired' END AS status, CASE WHEN hit THEN n_nationkey ELSE -1 END AS value, (SELECT count(*) FROM h WHERE hit) AS entries FROM h""",
    "cache_hit": "SELECT o_orderstatus, count(*) AS n, 1 AS runs, 1 AS hits FROM orders GROUP BY 1",
    "dataset_parquet": "SELECT * FROM nation",
    "dataset_orc": "SELECT * FROM nation",
    "dataset_json": "SELECT * FROM nation",
    "dataset_csv": "SELECT * FROM nation",
    "dataset_text": "SELECT r_name AS value FROM region",
    "dataset_key_template": """
        SELECT 'orders/' || o_orderstatus || '_' || (row_number() OVER (ORDER BY o_orderstatus) - 1) || '.parquet' AS key, count(*) AS n FROM orders GROUP BY o_orderstatus""",
    "format_hint": r"""
        SELECT page_id, lower(regexp_extract('Page_' || page_id || CASE WHEN page_id % 2 = 0 THEN '.CSV' ELSE '.tar.GZ' END, '\.([^.]+)$', 1)) AS ext FROM pages""",
    "template_resolve": "SELECT doc_id, replace('out_{lang}_{missing}.csv', '{lang}', lang) AS k FROM documents",
    "resolver_chain": """
        SELECT n_nationkey, CASE WHEN n_nationkey & 1 > 0 THEN 'call' WHEN n_nationkey & 2 > 0 THEN 'task' WHEN n_nationkey & 4 > 0 THEN 'session' ELSE 'settings' END AS store,
          CASE WHEN n_nationkey & 1 > 0 THEN 'distributed' WHEN n_nationkey & 2 > 0 THEN 'threads' WHEN n_nationkey & 4 > 0 THEN 'inline' ELSE 'sequential' END AS backend FROM nation""",
    "canonical_set": """
        SELECT v, CAST(1 AS BIGINT) AS kinds, count(*) AS n FROM (SELECT array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS v FROM orders GROUP BY o_custkey) GROUP BY v""",
    "event_counts": """
        WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_regionkey = 0) AS bad FROM nation),
        e AS (SELECT unnest(['before_session_start', 'before_node_execute', 'before_node_retry', 'after_node_retry', 'on_node_error', 'after_node_execute', 'after_session_end']) AS event,
          unnest([1, n, bad, bad, bad, n - bad, 1]) AS n FROM f)
        SELECT event, n, CASE WHEN event LIKE '%session%' THEN 0 ELSE n END AS tasks FROM e WHERE n > 0""",
    "event_payload": """
        SELECT i AS map_index, 'in_region[' || i || ']' AS name, 'nation ' || n_nationkey || ' is in region 0' AS error
        FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, * FROM nation) WHERE n_regionkey = 0""",
    "event_parent": """
        SELECT 'region_' || n_regionkey AS name, CAST(NULL AS VARCHAR) AS parent FROM nation GROUP BY n_regionkey
        UNION ALL SELECT 'nation_' || n_nationkey, 'region_' || n_regionkey FROM nation""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "fmt_duration": """
        SELECT event_id, CASE WHEN value < 60 THEN CAST(floor(value) AS BIGINT) || ' s' ELSE CAST(floor(value / 60) AS BIGINT) || ' min' END AS t FROM events""",
    "retry_flaky": "SELECT count(*) AS n, CAST(3 AS INTEGER) AS attempts FROM nation",
    "gather_concurrent": """
        SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier""",
    "map_arrays": "SELECT l_orderkey, CAST(sum(l_linenumber * 2) AS BIGINT) AS result FROM lineitem GROUP BY l_orderkey",
    "stream_rows": "SELECT p_partkey, CAST(v AS INTEGER) AS iter_index, v AS value FROM (SELECT p_partkey, unnest(range(p_size % 5)) AS v FROM part)",
    "stream_call": """
        WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS nation, n_regionkey FROM nation)
        SELECT nation, kind, unnest(range(n_regionkey)) AS item, (SELECT CAST(2 * sum(n_regionkey) AS BIGINT) FROM n) AS iterations FROM n, (VALUES ('sync'), ('async')) AS k(kind)""",
    "cache_replaced": "SELECT n_nationkey, CAST(1 AS BIGINT) AS tables FROM nation WHERE n_regionkey >= 2",
    "dataset_raw": r"SELECT hex('\x00\x01taskloom'::BLOB) AS content",
    "dataset_values": """
        SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS n_nationkey, row_number() OVER (ORDER BY n_nationkey) > 1 AS has_text, n_name AS raw, n_name AS pickled,
          len(list_distinct(string_split(n_name, ''))) AS letters, 3 * count(*) OVER () - 1 AS keys FROM nation""",
    "task_names": "SELECT i AS map_index, 'nation_' || n_nationkey || '[' || i || ']' AS name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_nationkey FROM nation)",
    "gather_async": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS map_index, CAST(n_nationkey * 2 AS BIGINT) AS result FROM nation",
    "map_raises_lowest": "SELECT 'Task ''not_seven[' || min(p_partkey) || ']'' failed with error: seven is bad' AS error FROM part WHERE p_size = 7",
    "setting_values": "SELECT count(*) AS n, CAST(2 AS BIGINT) AS parts FROM nation",
}
