"""Numbered changes of many clients, applied in their numbers' order by a stateful streaming query with event-time timers.

Each client's changes bear numbers. A change whose number is the client's next is applied; one that comes too early is
held; one whose number is held or was passed is rejected. A gap is waited for: a timer stands at the earliest held day,
and once the watermark (the largest day so far, less ``WAIT`` days) has reached it, the next number jumps to the smallest
held one, until no change held is that old.

How the rules map onto Structured Streaming:

* The changes are cut into batches by day. Each batch is added to the source's folder and the query is started anew on one
  checkpoint, with ``availableNow``: it reads the batch, and then runs once more without data, as the watermark has moved.
  Timers that this no-data run fires belong to the *beginning of the next batch*, so their rows are labelled with its number.
  As batches follow each other in days, no row of a batch is late, and no timer can fire while a batch's data are read.
* After the last batch a sentinel row with a later day than all others moves the watermark beyond every held day: its
  no-data run flushes what is held, labelled with the number after the last.
* ``transformWithState`` holds the state in the state store on disk. Clients are dealt into slots by hash, some
  ``SLOT_ROWS`` changes each, as a call per client costs more than its few changes; a slot's timer stands at the earliest
  held day of its clients. The clients' positions are one value per slot; each held change is an entry of a map of its own,
  read one at a time or as a stream.

Within a batch the order of arrival does not matter: the next number only moves on when its own change is there, so of the
changes with one number the first by day and change_id counts and the others are rejected. So nothing has to be sorted, and
a call keeps at most ``FRESH`` changes in memory; the rest goes to the state store.

Scale: numbers (dense ranks of ``seq`` per client) are places in a range-sorted table of distinct (client, seq) pairs, cut
evenly however many changes one client has. Nothing that grows with the input goes to the driver, into a broadcast or
through one task. What stays together is the state of one client, whose changes depend on each other: a client with a third
of all changes makes its slot's task the longest of a batch (in memory it is bounded).

Defined cases: rows without ``valid_at`` vanish after the ranks are taken, and so do a share of all others (``SKIP``) and
rows without ``change_id``. A null client is a client like any other; a null ``seq`` ranks first. An unknown or null ``op`` takes its number
and changes nothing. Days before ``FIRST`` belong to batch 1. Repeated rows count once; rows that differ but have one
client, number, day and change_id are ordered by their other columns. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.order import group_places
from .common import discard, read, remember, shared_dir, ship, table

FIRST, DAYS, BATCHES, WAIT = 19723, 160, 10, 8
LATE_SHARE, LATE_DAYS, SKIP = 4, 5, 11
SLOT_ROWS = 2000
#: Changes that a call keeps in memory before they go to the state store.
FRESH = 20_000
_DAY_MS = 86_400_000

IN = "slot long, client_id long, n long, day int, change_id long, op string, city string, cents long, stamp timestamp"
OUT = "change_id long, client_id long, n long, op string, status string, late boolean, missed long, city string, cents long"
_STATE = "clients array<long>, nexts array<long>, cities array<string>, cents array<long>, held array<long>, low array<long>, timer long"
#: The map's keys are numbers of a client; -1 in place of a null client would meet a real one, so a flag goes along.
_KEY, _VALUE = "none boolean, client long, n long", "day int, change_id long, op string, city string, cents long"

_NEXT, _CITY, _CENTS, _HELD, _LOW = range(5)


class Apply(StatefulProcessor):
    """One slot of clients. ``at``: per client, the next number, city, cents, how many changes it holds, their earliest day."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clients", _STATE)
        self.held = handle.getMapState("held", _KEY, _VALUE)

    # --- state ---

    def _load(self) -> None:
        s = self.state.get()
        self.at = {} if s is None else {c: [a, b, d, e, f] for c, a, b, d, e, f in zip(*s[:6])}
        self.timer = None if s is None else s[6]

    def _save(self) -> None:
        low = min((x[_LOW] for x in self.at.values() if x[_LOW] is not None), default=None)
        if low != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer * _DAY_MS)
            if low is not None:
                self.handle.registerTimer(low * _DAY_MS)
        x = list(self.at.values())
        self.state.update((list(self.at), *[[y[k] for y in x] for k in range(5)], low))

    @staticmethod
    def _key(client, n: int) -> tuple:
        return (client is None, -1 if client is None else client, n)

    def _get(self, client, n: int):
        return self.held.getValue(self._key(client, n)) if self.at[client][_HELD] else None

    def _put(self, client, n: int, x: tuple, new: bool = True) -> None:
        self.held.updateValue(self._key(client, n), x)
        a = self.at[client]
        a[_HELD] += new
        a[_LOW] = x[0] if a[_LOW] is None else min(a[_LOW], x[0])

    def _take(self, client, n: int) -> None:
        self.held.removeKey(self._key(client, n))
        self.at[client][_HELD] -= 1

    def _entries(self, wanted: set) -> Iterator[tuple]:
        for (none, client, n), x in self.held.iterator():
            c = None if none else client
            if c in wanted:
                yield c, n, tuple(x)

    def _lows(self, clients: set) -> None:
        """Finds the earliest held days of some clients anew, in one pass over what the slot holds."""
        for c in clients:
            self.at[c][_LOW] = None
        open_ = {c for c in clients if self.at[c][_HELD]}
        if open_:
            for c, _, x in self._entries(open_):
                low = self.at[c][_LOW]
                self.at[c][_LOW] = x[0] if low is None else min(low, x[0])

    # --- rules ---

    def _applied(self, client, n: int, x: tuple, late: bool) -> Row:
        a = self.at[client]
        missed, a[_NEXT] = n - a[_NEXT], n + 1
        _, change_id, op, city, cents = x
        if op in ("I", "D"):
            a[_CITY], a[_CENTS] = (city, cents) if op == "I" else (None, None)
        elif op == "U":
            a[_CITY] = a[_CITY] if city is None else city
            a[_CENTS] = a[_CENTS] if cents is None else cents
        return Row(change_id=change_id, client_id=client, n=n, op=op, status="applied", late=late, missed=missed, city=a[_CITY], cents=a[_CENTS])

    @staticmethod
    def _rejected(client, n: int, x: tuple) -> Row:
        return Row(change_id=x[1], client_id=client, n=n, op=x[2], status="rejected", late=False, missed=0, city=None, cents=None)

    @staticmethod
    def _order(x: tuple) -> tuple:
        return (x[0], x[1], *[(y is not None, y) for y in x[2:]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        fresh: dict[tuple, tuple] = {}
        touched = set()
        for r in rows:
            client, n, x = r.client_id, r.n, (r.day, r.change_id, r.op, r.city, r.cents)
            if n == 0:  # the sentinel
                continue
            a = self.at.setdefault(client, [1, None, None, 0, None])
            if n < a[_NEXT]:
                yield self._rejected(client, n, x)
                continue
            stored = None if (client, n) in fresh else self._get(client, n)
            old = fresh.get((client, n)) if stored is None else tuple(stored)
            if old is not None:
                # Held changes of earlier batches have earlier days; of one batch's, the first in order stays.
                first, last = sorted((old, x), key=self._order)
                yield self._rejected(client, n, last)
                if first is old:
                    continue
                x = first
            if stored is not None:
                self._put(client, n, x, new=False)
            else:
                fresh[client, n] = x
            touched.add(client)
            if len(fresh) >= FRESH:
                for (c, m), y in fresh.items():
                    self._put(c, m, y)
                fresh.clear()
        stale = set()
        for client in touched:
            while True:
                n = self.at[client][_NEXT]
                x = fresh.pop((client, n), None)
                if x is None:
                    x = self._get(client, n)
                    if x is None:
                        break
                    x = tuple(x)
                    self._take(client, n)
                    stale.add(client)
                yield self._applied(client, n, x, late=False)
        for (client, n), x in fresh.items():
            self._put(client, n, x)
        self._lows(stale)
        self._save()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        # This timer is deleted by Spark after the call; it must not be taken for a standing one.
        due_day = timerValues.getCurrentWatermarkInMs() // _DAY_MS
        due = {c for c, a in self.at.items() if a[_LOW] is not None and a[_LOW] <= due_day}
        if self.timer is not None and self.timer * _DAY_MS == expiredTimerInfo.getExpiryTimeInMs():
            self.timer = None
        # Jumps go on while a held change is due, always to the smallest number held: whatever is held up to the
        # largest due number is applied, and then what follows it without a gap.
        upto: dict = {}
        for c, n, x in self._entries(due):
            if x[0] <= due_day:
                upto[c] = max(n, upto.get(c, 0))
        done: tuple | None = None
        order = lambda e: (e[0] is not None, e[0] or 0, e[1])
        while due:
            part = heapq.nsmallest(FRESH, (e for e in self._entries(due) if done is None or order(e) > done), key=order)
            for client, n, x in part:
                if n <= upto[client] or n == self.at[client][_NEXT]:
                    self._take(client, n)
                    yield self._applied(client, n, x, late=True)
            if len(part) < FRESH:
                break
            done = order(part[-1])
        self._lows(due)
        self._save()

    def close(self) -> None:
        pass


def numbered(changes: DataFrame) -> DataFrame:
    """The distinct changes with their number ``n`` (the dense rank of ``seq`` within the client), day and batch."""
    d = table(changes.dropDuplicates().select("change_id", "client_id", "seq", "op", "valid_at", "city", "balance"), "changes")
    pairs = d.select(F.col("client_id").alias("c"), F.col("seq").alias("s")).distinct()
    ranks = table(group_places(pairs, ["c"], "s"), "ranks")
    h = F.crc32(F.col("change_id").cast("string").cast("binary"))
    kept = d.where(F.col("valid_at").isNotNull() & F.col("change_id").isNotNull()).withColumn("h", h).where(f"h % {SKIP} <> 0")
    day = F.unix_date(F.to_date("valid_at")) + (F.lit(LATE_DAYS) * (F.col("h") % LATE_SHARE)).cast("int")
    kept = kept.join(ranks, kept["client_id"].eqNullSafe(ranks["c"]) & kept["seq"].eqNullSafe(ranks["s"])).withColumn("day", day)
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), F.floor((F.col("day") - FIRST) * F.lit(BATCHES) / F.lit(DAYS)) + 1)).cast("int")
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long")
    return kept.select("client_id", (F.col("place") + 1).alias("n"), "day", "change_id", "op", "city", cents.alias("cents"), batch.alias("batch"))


def _session(spark: SparkSession, slots: int) -> SparkSession:
    """A session of its own, so that the caller's settings stay: the state is in RocksDB, with changes as its checkpoint.

    Each start of the query opens stores of its own on the executors' disks; those of earlier starts are closed and deleted
    within seconds, and no space is set aside in advance. Neither row counts nor checksum files, which nothing reads here, are kept. A partition of state has two slots at least.
    """
    s = spark.newSession()
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
        "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "true",
        "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
        "spark.sql.shuffle.partitions": str(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), slots // 2))),
    }
    for key, value in settings.items():
        s.conf.set(key, value)
    return s


def apply_changes(changes: DataFrame) -> DataFrame:
    """``(change_id, client_id, status, batch, missed, city, cents, current)`` per distinct row that takes part."""
    spark = changes.sparkSession
    ship(spark)
    root = f"{shared_dir(spark)}/weftgraph-changes-{uuid.uuid4().hex}"
    rows = table(numbered(changes), "numbered")
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.max("day").alias("last")).first()
    slots = max(8, -(-seen["rows"] // SLOT_ROWS))
    own = _session(spark, slots)
    source = own.read.schema(rows.schema).parquet(rows._weftgraph_path)
    fed = source.select(F.pmod(F.xxhash64("client_id"), F.lit(slots)).alias("slot"), "client_id", "n", "day", "change_id", "op", "city", "cents", F.timestamp_seconds(F.col("day").cast("long") * 86_400).alias("stamp"), "batch")

    def start(batch: int, more: DataFrame) -> None:
        """Adds a batch's files to the source and runs the query on all that is new."""
        more.write.mode("append").parquet(f"{root}/in")
        stream = own.readStream.schema(IN).parquet(f"{root}/in").withWatermark("stamp", f"{WAIT} days")
        # The processor's schemas are asked of a Python process that gets no files: the class goes along by value.
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
        try:
            out = stream.groupBy("slot").transformWithState(Apply(), OUT, "Append", "EventTime")
        finally:
            cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
        out = out.withColumn("batch", F.lit(batch) + F.col("late").cast("int"))
        sink = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append")
        sink.trigger(availableNow=True).start().awaitTermination()

    if seen["rows"]:
        for b in range(1, BATCHES + 1):
            start(b, fed.where(F.col("batch") == b).drop("batch"))
        last = seen["last"] + 2 * WAIT
        start(BATCHES, own.sql(f"SELECT 0L AS slot, CAST(NULL AS BIGINT) AS client_id, 0L AS n, {last} AS day, 0L AS change_id, '' AS op, '' AS city, 0L AS cents, timestamp_seconds({last} * 86400L) AS stamp"))
    schema = f"{OUT}, batch int"
    done = spark.read.schema(schema).parquet(f"{root}/out") if seen["rows"] else spark.createDataFrame([], schema)
    remember(done, root)
    discard(rows)
    applied = done.where("status = 'applied'")
    last_n = applied.groupBy(F.col("client_id").alias("c")).agg(F.max("n").alias("m"))
    match = F.col("client_id").eqNullSafe(F.col("c")) & (F.col("n") == F.col("m")) & (F.col("status") == "applied")
    current = F.col("m").isNotNull() & ~F.col("op").eqNullSafe(F.lit("D"))
    return done.join(last_n, match, "left").select("change_id", "client_id", "status", "batch", "missed", "city", "cents", current.alias("current"))


def op13_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_changes(read(spark, sf_dir, "client_changes"))


#: The same result without a stream. CRC-32 goes byte by byte through a table. Of the rows with one client and number only the
#: first by day and id can be applied; it is rejected if a larger number of its client was due when it came. ``nx``: the next
#: number after each batch, beyond what was due at its start and whatever follows without a gap.
ORACLE = f"""
WITH RECURSIVE bits(k, v, i) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc(change_id, s, i, c) AS (SELECT DISTINCT change_id, CAST(change_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM client_changes WHERE change_id IS NOT NULL
  UNION ALL SELECT w.change_id, w.s, w.i + 1, xor(b.v, w.c >> 8) FROM crc w JOIN bits b ON b.i = 8 AND b.k = xor(w.c, ord(w.s[w.i + 1])) & 255 WHERE w.i < length(w.s)),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY client_id ORDER BY seq NULLS FIRST) AS n FROM (SELECT DISTINCT * FROM client_changes)),
hashed AS (SELECT r.*, xor(c.c, 4294967295) AS h FROM ranked r JOIN crc c ON c.change_id = r.change_id AND c.i = length(c.s)),
dated AS (SELECT change_id, client_id, n, op, city, CAST(floor(100 * balance + 0.5) AS BIGINT) AS cents, date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + {LATE_DAYS} * (h % {LATE_SHARE}) AS day FROM hashed WHERE valid_at IS NOT NULL AND h % {SKIP} <> 0),
rows AS (SELECT *, greatest(1, least({BATCHES}, 1 + CAST(floor((day - {FIRST}) * {BATCHES} / {DAYS}.0) AS INTEGER))) AS batch, row_number() OVER (PARTITION BY client_id, n ORDER BY day, change_id, op NULLS FIRST, city NULLS FIRST, cents NULLS FIRST) AS nth FROM dated),
due AS (SELECT b, max(day) - {WAIT} AS upto FROM range(2, {BATCHES + 1}) t(b) JOIN rows ON batch < b GROUP BY b),
jump AS (SELECT client_id, b, max(n) AS m FROM rows JOIN due ON day <= upto GROUP BY client_id, b),
island AS (SELECT client_id, b, min(n) AS lo, max(n) AS hi FROM (SELECT client_id, b, n, n - row_number() OVER (PARTITION BY client_id, b ORDER BY n) AS g FROM rows JOIN range(1, {BATCHES + 1}) t(b) ON batch <= b WHERE nth = 1) GROUP BY client_id, b, g),
nx(client_id, b, next) AS (SELECT DISTINCT client_id, CAST(0 AS BIGINT), CAST(1 AS BIGINT) FROM rows
  UNION ALL SELECT x.client_id, x.b + 1, coalesce(i.hi + 1, greatest(x.next, coalesce(j.m + 1, 1))) FROM nx x LEFT JOIN jump j ON j.client_id IS NOT DISTINCT FROM x.client_id AND j.b = x.b + 1
  LEFT JOIN island i ON i.client_id IS NOT DISTINCT FROM x.client_id AND i.b = x.b + 1 AND greatest(x.next, coalesce(j.m + 1, 1)) BETWEEN i.lo AND i.hi WHERE x.b < {BATCHES}),
judged AS (SELECT r.*, r.nth = 1 AND coalesce(j.m, 0) < r.n AS ok FROM rows r LEFT JOIN jump j ON j.client_id IS NOT DISTINCT FROM r.client_id AND j.b = r.batch),
applied AS (SELECT r.change_id, r.client_id, r.n, r.op, r.city, r.cents, coalesce(min(x.b), {BATCHES + 1}) AS batch FROM judged r LEFT JOIN nx x ON x.client_id IS NOT DISTINCT FROM r.client_id AND x.b >= r.batch AND x.next > r.n WHERE r.ok GROUP BY ALL),
steps AS (SELECT *, n - 1 - coalesce(lag(n) OVER w, 0) AS missed, n = max(n) OVER (PARTITION BY client_id) AND op IS DISTINCT FROM 'D' AS current,
  sum(CASE WHEN op IN ('I', 'D') OR op = 'U' AND city IS NOT NULL THEN 1 ELSE 0 END) OVER w AS gc, sum(CASE WHEN op IN ('I', 'D') OR op = 'U' AND cents IS NOT NULL THEN 1 ELSE 0 END) OVER w AS gb FROM applied WINDOW w AS (PARTITION BY client_id ORDER BY n))
SELECT change_id, client_id, 'applied' AS status, CAST(batch AS INTEGER) AS batch, CAST(missed AS BIGINT) AS missed, max(CASE WHEN op IN ('I', 'U') AND gc > 0 THEN city END) OVER (PARTITION BY client_id, gc) AS city, max(CASE WHEN op IN ('I', 'U') AND gb > 0 THEN cents END) OVER (PARTITION BY client_id, gb) AS cents, current FROM steps
UNION ALL SELECT change_id, client_id, 'rejected', batch, 0, NULL, NULL, false FROM judged WHERE NOT ok
"""


def brute(rows: list[tuple], batches: int = BATCHES) -> list[tuple]:
    """Plain reference for tests: the rules over ``(client_id, n, day, change_id, op, city, cents, batch)``, row by row."""
    out, state, most = [], {}, None
    key = lambda r: (r[2], r[3], [(y is not None, y) for y in r[4:7]])

    def apply(c, late, b):
        s = state[c]
        r = s["held"].pop(late)
        missed, s["next"] = late - s["next"], late + 1
        if r[4] == "I":
            s["now"] = (r[5], r[6])
        elif r[4] == "U":
            s["now"] = (s["now"][0] if r[5] is None else r[5], s["now"][1] if r[6] is None else r[6])
        elif r[4] == "D":
            s["now"] = (None, None)
        s["last"] = len(out), r[4]
        out.append([r[3], c, "applied", b, missed, *s["now"], False])

    def run(c, b):
        while state[c]["next"] in state[c]["held"]:
            apply(c, state[c]["next"], b)

    for b in range(1, batches + 2):
        for c in state:
            held = state[c]["held"]
            while held and (b > batches or min(r[2] for r in held.values()) + WAIT <= most):
                apply(c, min(held), b)
                run(c, b)
        today = sorted((r for r in rows if r[7] == b), key=key)
        for r in today:
            s = state.setdefault(r[0], {"next": 1, "held": {}, "now": (None, None), "last": None})
            if r[1] < s["next"] or r[1] in s["held"]:
                out.append([r[3], r[0], "rejected", b, 0, None, None, False])
                continue
            s["held"][r[1]] = r
            run(r[0], b)
        most = max([r[2] for r in today] + ([] if most is None else [most]), default=None)
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][7] = True
    return [tuple(x) for x in out]
