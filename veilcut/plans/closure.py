"""The subset closure: which rows of which tables a sample of the root needs.

Work items (table, keys, mode, depth) are taken in FIFO order.  Keys already selected are subtracted, the rest is
selected; parents of new rows follow in full, children only of CHILD_OK rows, up to `cap` rows per parent key and
edge, and to `depth`.  The mode of a row is that of the item that brought it first, so the order of items is part of
the result: edges go by constraint name, one item an edge.  Items in front of the queue that are about different tables don't
depend on each other; their jobs run side by side and take effect in order.  Up to SMALL keys of an item are kept on the
driver, found in one job; more are tables in shared storage, of which only counts come to the driver, so the walk holds for any number of keys.
"""

from __future__ import annotations

from collections import deque
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Catalog, ForeignKey, Mode, Refusal, Request, Step
from ..sources.storage import durable
from . import identity as identities
from .where import check_predicate


#: Keys of an item that the driver keeps at most (of at most KEY_BYTES together).
SMALL = 10_000
KEY_BYTES = 1 << 20
LOOKUP_ROWS = 1_000


def seed(df: DataFrame, key: tuple[str, ...], take: int, where: str | None = None) -> DataFrame:
    """The first `take` identities by order, of the rows that meet the predicate."""
    if where:
        if bad := check_predicate(where):
            raise Refusal([f"the predicate has {bad[1]} at {bad[0]}"], code=2)
        df = df.where(F.expr(where))
    return df.select(*key).orderBy(*key).limit(take)


def selected_rows(df: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of df whose identity is in keys; Spark broadcasts the keys when their size allows it."""
    return df.join(keys.select(*key), list(key), "left_semi")


def parent_keys(child_rows: DataFrame, edge: ForeignKey, parent: DataFrame, parent_key: tuple[str, ...]) -> DataFrame:
    """Distinct identities of the parents that rows refer to; a reference with a null refers to nothing."""
    typed = child_rows.where(F.col(edge.discriminator[0]) == edge.discriminator[1]) if edge.discriminator else child_rows
    refs = typed.select(*(F.col(c).alias(p) for c, p in zip(edge.child_columns, edge.parent_columns))).dropna().distinct()
    if tuple(edge.parent_columns) == tuple(parent_key):
        return parent.select(*parent_key).join(refs, list(parent_key), "left_semi")
    return parent.join(refs, list(edge.parent_columns), "left_semi").select(*parent_key).distinct()


def child_keys(child: DataFrame, edge: ForeignKey, parent_rows: DataFrame, child_key: tuple[str, ...], cap: int) -> DataFrame:
    """Identities of the children of rows, the first `cap` by identity for each parent key."""
    refs = parent_rows.select(*(F.col(p).alias(c) for c, p in zip(edge.child_columns, edge.parent_columns))).dropna().distinct()
    columns = list(dict.fromkeys([*edge.child_columns, *child_key]))
    near = child.select(*columns).join(refs, list(edge.child_columns), "left_semi")
    place = "_rank"
    while place in columns:
        place += "_"
    rank = F.row_number().over(Window.partitionBy(*edge.child_columns).orderBy(*child_key))
    return near.withColumn(place, rank).where(F.col(place) <= cap).select(*child_key).distinct()


def key_bytes(df: DataFrame) -> int:
    """Static width of a key row; strings count as 32 bytes."""
    width = {"bigint": 8, "int": 4, "smallint": 2, "timestamp": 8, "date": 4, "double": 8}
    return sum(width.get(t, 32) for _, t in df.dtypes)


def kept(keys: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Keys with their number: a few on the driver, after one job; more in shared storage."""
    most = min(SMALL, KEY_BYTES // key_bytes(keys))
    few = keys.limit(most + 1).toArrow()
    if few.num_rows <= most:
        return keys.sparkSession.createDataFrame(few, keys.schema), few.num_rows
    held = durable(keys, f"keys-{name}")
    return held, held.count()


def walk(catalog: Catalog, frames: dict[str, DataFrame], request: Request, lookups: frozenset[str] = frozenset()) -> dict[str, Step]:
    """The steps of a plan, by table: identity, keys, mode, rows and the least depth.

    All reasons for a refusal are collected: an edge to a table without identity is left out and the walk goes on.
    """
    request.check()
    if request.root is None:
        raise Refusal(["no root"], code=2)
    catalog = catalog.without(set(request.skip))
    keys_of: dict[str, tuple[str, ...]] = {}
    problems: list[str] = []

    def resolve(name: str) -> tuple[str, ...]:
        return identities.resolve(catalog, catalog.table(name), frames[name], request.keys.get(name)).columns

    def key(name: str) -> tuple[str, ...]:
        if name not in keys_of:
            keys_of[name] = probes[name].result() if name in probes else resolve(name)
        return keys_of[name]

    steps: dict[str, Step] = {}
    total = 0

    def fresh_of(item) -> tuple[DataFrame, int]:
        name, keys = item[0], item[1]
        step = steps.get(name)
        return kept(keys if step is None else keys.join(step.keys, list(key(name)), "left_anti"), name)

    with ThreadPoolExecutor(8) as jobs:
        probes = {n: jobs.submit(resolve, n) for n in request.keys if n in {t.name for t in catalog.tables}}  # keys that were given are probed meanwhile
        queue = deque([(request.root, seed(frames[request.root], key(request.root), request.take, request.where), Mode.CHILD_OK, 0, "root")])
        while queue:
            batch = [queue.popleft()]
            while queue and queue[0][0] not in {b[0] for b in batch}:
                batch.append(queue.popleft())
            for (name, _, mode, depth, why), (fresh, n) in zip(batch, jobs.map(fresh_of, batch)):
                if not n:
                    continue
                step = steps.get(name)
                if step is None:
                    step = steps[name] = Step(name, mode, key(name), fresh, n, depth, why)
                else:
                    step.keys, step.rows, step.depth = step.keys.unionByName(fresh), step.rows + n, min(step.depth, depth)
                    step.mode = Mode.CHILD_OK if Mode.CHILD_OK in (step.mode, mode) else step.mode
                total += n * key_bytes(fresh)
                if step.rows > request.row_budget or total > request.byte_budget:
                    raise Refusal([*problems, f"{name} takes the plan over its budget of {'rows' if step.rows > request.row_budget else 'bytes'}"])
                rows = selected_rows(frames[name], fresh, key(name))
                for edge in catalog.outgoing(name):
                    # rows that came as children along an edge have their parents of that edge already
                    if edge.parent in lookups or not (edge.validated or edge.virtual) or (edge.name == why and mode is Mode.CHILD_OK):
                        continue
                    try:
                        queue.append((edge.parent, parent_keys(rows, edge, frames[edge.parent], key(edge.parent)), Mode.PARENT_ONLY, depth, edge.name))
                    except Refusal as e:
                        problems += e.causes
                if mode is Mode.CHILD_OK and depth < request.depth:
                    for edge in catalog.incoming(name):
                        if edge.virtual or edge.child in lookups:
                            continue
                        cap = request.caps.get(edge.child, request.cap)
                        try:
                            queue.append((edge.child, child_keys(frames[edge.child], edge, rows, key(edge.child), cap), Mode.CHILD_OK, depth + 1, edge.name))
                        except Refusal as e:
                            problems += e.causes
    if problems:
        raise Refusal(sorted(set(problems)))
    return steps


def small_lookups(names: list[str], frames: dict[str, DataFrame], most: int = LOOKUP_ROWS) -> frozenset[str]:
    """Of tables that look like code lists those of at most `most` rows, counted up to one more."""
    return frozenset(n for n in names if identities.bounded_count(frames[n], most + 1).first().n <= most)


def add_lookups(steps: dict[str, Step], catalog: Catalog, frames: dict[str, DataFrame], lookups: frozenset[str]) -> None:
    """Small code lists are copied whole; one that has more than LOOKUP_ROWS rows is refused, not cut."""
    large = sorted(set(lookups) - small_lookups(sorted(lookups), frames))
    if large:
        raise Refusal([f"{n} has more than {LOOKUP_ROWS} rows, too many for a lookup" for n in large])
    for name in sorted(lookups):
        key = catalog.table(name).primary_key or tuple(c.name for c in catalog.table(name).columns)
        keys, n = kept(frames[name].select(*key), name)
        steps[name] = Step(name, Mode.LOOKUP, key, keys, n, 0, "lookup")


def report(steps: dict[str, Step], spark) -> DataFrame:
    rows = [(s.table, s.mode.value, s.rows, s.depth, ",".join(s.identity), s.why) for s in steps.values()]
    return spark.createDataFrame(rows, "table_name string, mode string, n_rows long, depth int, identity string, via string")


