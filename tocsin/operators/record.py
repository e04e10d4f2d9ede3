"""Append-only forecast record with a hash chain."""
from pyspark.sql import DataFrame, functions as F

GENESIS = "0" * 64


def digest(prev, body):
    return F.sha2(F.concat(prev, F.lit("|"), body), 256)


def chain(rows: DataFrame, order, fields, by=(), start=None, body=None) -> DataFrame:
    """Adds seq, prev_hash and hash: each row's hash covers the one before it in its (by) chain.

    Chaining is sequential by nature: a chain's rows are sorted by Spark and streamed through one task, which holds the last hash and nothing else.
    start: Column with the last hash already logged (the zero hash where nothing is). body: the fields that are hashed, if not all.
    """
    import hashlib
    by, fields = list(by), list(fields)
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in body or fields])
    rest = [f for f in fields if f not in by]
    d = rows.select(*by, *rest, F.col(order).alias("_o"), (F.lit(GENESIS) if start is None else start).alias("_start"), text.alias("_text"))
    d = (d.repartition(*by) if by else d.repartition(1)).sortWithinPartitions(*by, "_o", "_text").drop("_o")
    keys = len(by)

    def link(batches):
        import pyarrow as pa
        now, seq, last = None, 0, None
        for b in batches:
            ids = list(zip(*(b.column(i).to_pylist() for i in range(keys)))) if keys else [()] * b.num_rows
            seqs, prevs, hashes = [], [], []
            for key, first, line in zip(ids, b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                if now is None or key != now[0]:
                    now, seq, last = (key,), 0, first
                seqs.append(seq)
                prevs.append(last)
                last = hashlib.sha256(f"{last}|{line}".encode()).hexdigest()
                hashes.append(last)
                seq += 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
                                             [*b.schema.names[:-2], "seq", "prev_hash", "hash"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-2])
    return d.mapInArrow(link, f"{schema}, seq long, prev_hash string, hash string").select(*by, "seq", *rest, "prev_hash", "hash")


def verify(log: DataFrame, fields, by=(), start=GENESIS) -> DataFrame:
    """First bad row per chain (NULL = intact) and its length. Rows meet their predecessor by an equi-join on seq, so a log of
    any length is checked in parallel."""
    body = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    before = log.select(*by, (F.col("seq") + 1).alias("seq"), F.col("hash").alias("_before"))
    j = log.join(before, [*by, "seq"], "left").withColumn("_before", F.when(F.col("seq") == 0, F.lit(start)).otherwise(F.col("_before")))
    bad = (F.col("_before").isNull() | (F.col("prev_hash") != F.col("_before")) | (F.col("hash") != digest(F.col("prev_hash"), body)))
    return j.groupBy(*by).agg(F.min(F.when(bad, F.col("seq"))).alias("first_bad"), F.count(F.lit(1)).alias("rows"))


def append_day(log_path: str, rows: DataFrame, day, order, fields) -> bool:
    """Log a day's rows once: nothing is written when the log already holds that day or a later one."""
    spark = rows.sparkSession
    start, base = GENESIS, 0
    try:
        last = spark.read.parquet(log_path).agg(F.max(F.struct("seq", "day", "hash")).alias("m")).first()["m"]
        if last is not None:
            if last["day"] >= day:
                return False
            start, base = last["hash"], last["seq"] + 1
    except Exception as e:       # first day: no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    out = chain(rows.withColumn("day", F.lit(day)), order, fields, by=("day",), start=F.lit(start)).withColumn("seq", F.col("seq") + base)
    out.write.mode("append").parquet(log_path)
    return True
