"""Evidence panel in long form, inheritance from parents, and the design matrix at the ML boundary."""
from pyspark.sql import DataFrame, functions as F

from tocsin.functions import scoring as S


def family(series_id, suffixes: str):
    """Family name: the id without its theatre suffix (`suffixes` is a regex alternation)."""
    return F.regexp_replace(series_id, f"_({suffixes})$", "")


def evidence(z: DataFrame) -> DataFrame:
    """theatre, day, family, direction, z -> strongest one-sided evidence per family, 0..5."""
    e = S.one_sided(F.col("z"), F.col("direction"), 5.0)
    return z.groupBy("theatre", "day", "family").agg(F.max(e).alias("e"))


def with_global(ev: DataFrame, theatres: DataFrame, name="global") -> DataFrame:
    """Global families copied to every theatre (the fixed theatre dimension); a theatre's own series of the same family is
    merged by max."""
    g = ev.where(F.col("theatre") == name).drop("theatre")
    names = theatres.agg(F.collect_set("theatre").alias("t")).scalar()
    spread = g.withColumn("theatre", F.explode(names))
    both = ev.where(F.col("theatre") != name).unionByName(spread)
    return both.groupBy("theatre", "day", "family").agg(F.max("e").alias("e"))


def with_parents(ev: DataFrame, parents: DataFrame) -> DataFrame:
    """A sub-theatre reads the stronger of its own and its parents' evidence. parents: theatre, parent."""
    up = ev.withColumnRenamed("theatre", "parent").join(parents, "parent").drop("parent")
    return ev.unionByName(up).groupBy("theatre", "day", "family").agg(F.max("e").alias("e"))


def wide(ev: DataFrame, families) -> DataFrame:
    """One column per family (the list is fixed, so no extra pass finds the pivot values); NULL = no score."""
    return ev.groupBy("theatre", "day").agg(*[F.max(F.when(F.col("family") == f, F.col("e"))).alias(f) for f in families])


def attach(panel: DataFrame, extra: DataFrame, keys=("theatre", "day")) -> DataFrame:
    return panel.join(extra, list(keys), "left")


def design(panel: DataFrame, theatres, families, pools=None, hist=("h1", "h3", "hs")) -> DataFrame:
    """Model columns: one offset per theatre (a sub-theatre also carries 1/n on each theatre it pools toward), history terms,
    evidence / 5 with 0 where missing."""
    pools = pools or {}
    def offset(t):
        c = F.when(F.col("theatre") == t, 1.0)
        for sub, pool in pools.items():
            if t in pool:
                c = c.when(F.col("theatre") == sub, 1.0 / len(pool))
        return c.otherwise(0.0).alias(f"t_{t}")
    keep = [c for c in panel.columns if c not in families]
    return panel.select(*keep, *[offset(t) for t in theatres], *[(F.coalesce(f, F.lit(0.0)) / 5).alias(f"w_{f}") for f in families])


def co_occurrence(wide_z: DataFrame, tanker, isr, fighter):
    """min(tanker, max(isr, fighter)), only where all three are scored."""
    ok = F.col(tanker).isNotNull() & F.col(isr).isNotNull() & F.col(fighter).isNotNull()
    return F.when(ok, F.least(F.col(tanker), F.greatest(F.col(isr), F.col(fighter))))


def domain_features(z: DataFrame, keys=("theatre", "day"), domains=3) -> DataFrame:
    """Days on which every domain is scored: any = max, domains_up = domains at 1.5 or more, mean_z = mean clipped domain z."""
    d = z.groupBy(*keys, "domain").agg(F.max("z").alias("dz"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("dz").alias("any"), F.count_if(F.col("dz") >= 1.5).alias("domains_up"),
                             F.avg(S.clip(F.col("dz"), 0.0, 5.0)).alias("mean_z"))
    return g.where(F.col("_n") == domains).drop("_n")
