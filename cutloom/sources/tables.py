"""Domain tables that Spark derives from the given ones; every rule here has its SQL in plans.sql."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Short frequent tokens that stand for fillers.
FILLERS = ("the", "que", "la", "in", "un", "les")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, on one machine a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: what stands before runs once, and lost executors cost a read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, turn, ws: the tokens of each turn."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), "turn", tokens(F.col("text")).alias("ws"))


def by_asset(df: DataFrame, share: int = 4) -> DataFrame:
    """df dealt by asset_id over a quarter (or share) of the tasks that shuffles are set to (up to 16: all), none of them merged:
    Spark merges by the size of what it shuffles, and the words of turns take many times the turns' room."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(n, max(n // share, 16)), "asset_id")


def timed(said: DataFrame, share: int = 4) -> DataFrame:
    """(asset_id, turn, ws) -> words with times in microseconds, as a recogniser would give them.  Turns move and are
    numbered on as a whole; words stay where their turns are.  share: of by_asset(), 1 where words take long."""
    order = Window.partitionBy("asset_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_asset(said, share).withColumn("ahead", F.coalesce(F.sum(F.size("ws")).over(order), F.lit(0)))
    tokenised = ahead.select("asset_id", "turn", "ahead", F.posexplode("ws").alias("p", "word"))
    n, i = F.length("word"), F.col("word_idx")
    lead = (
        F.when(F.col("word").rlike(r"[.!?]$"), 600000 + (n * 137 + i * 31) % 700 * 1000)
        .when(F.col("word").rlike(",$"), 280000 + (n * 53 + i * 17) % 250 * 1000)
        .otherwise((n * 29 + i * 7) % 120 * 1000)
    ) + F.when((F.col("p") == 0) & (F.col("turn") > 0), 1500000).otherwise(0)
    out = tokenised.withColumn("word_idx", (F.col("ahead") + F.col("p")).cast("int")).withColumn("dur", 60000 + 40000 * n)
    end = F.sum(F.col("dur") + lead).over(Window.partitionBy("asset_id").orderBy("word_idx").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("end_us", end.cast("long")).withColumn("start_us", F.col("end_us") - F.col("dur"))
    milli = (F.ascii("word").cast("long") * 31 + n * 17 + i * 7) % 1000
    return out.select("asset_id", "word_idx", "turn", "word", "start_us", "end_us", milli.cast("long").alias("conf_milli"))


def words(spark: SparkSession, sf_dir: str, share: int = 4) -> DataFrame:
    """The words of all conversations."""
    return timed(turns(spark, sf_dir), share)


def drop_window() -> tuple[Column, Column, Column]:
    """Whether a word of very low confidence marks a window to drop, and where it starts and ends."""
    return F.col("conf_milli") < 20, F.greatest(F.col("start_us") - 200000, F.lit(0)), F.col("end_us") + 400000


def drops(w: DataFrame) -> DataFrame:
    """Windows to drop around words of very low confidence."""
    marked, start, end = drop_window()
    return w.filter(marked).select("asset_id", start.alias("start_us"), end.alias("end_us"), F.when(F.col("word_idx") % 2 == 0, "reviewer").otherwise("rule").alias("reason"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script sentences from benchmark items: item_id, sent_id, text."""
    parts = F.split(F.regexp_replace("text", r"([.!?])", "$1\u0001"), "\u0001")
    s = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(parts).alias("p", "text"))
    s = s.withColumn("text", F.trim("text")).filter(F.length("text") >= 4)
    order = Window.partitionBy("item_id").orderBy("p")
    return s.select("item_id", F.row_number().over(order).alias("sent_id"), "text")


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording's own script: asset_id, sent_id, text.  Sentences of every third turn, as they were written before a
    seventh of their words was left out."""
    talk = read(spark, sf_dir, "conversations").filter("turn % 3 = 0").select(F.col("conv_id").alias("asset_id"), "turn", "text")
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])", "$1\u0001"), "\u0001")
    s = talk.select("asset_id", "turn", F.posexplode(parts).alias("p", "text"))
    s = s.withColumn("text", F.array_join(F.filter(tokens(F.col("text")), lambda w, i: i % 7 != 5), " ")).filter(F.length("text") >= 4)
    order = Window.partitionBy("asset_id").orderBy("turn", "p")
    return s.select("asset_id", F.row_number().over(order).alias("sent_id"), "text")


def taken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns() as takes: in every third turn of eight words and more the first eight are said twice."""
    said = F.when((F.col("turn") % 3 == 1) & (F.size("ws") >= 8), F.concat(F.slice("ws", 1, 8), "ws")).otherwise(F.col("ws"))
    return turns(spark, sf_dir).select("asset_id", "turn", said.alias("ws"))


def takes(spark: SparkSession, sf_dir: str, share: int = 4) -> DataFrame:
    """The words of all conversations as takes."""
    return timed(taken_turns(spark, sf_dir), share)


def in_turns(found: DataFrame, said: DataFrame, column: str) -> DataFrame:
    """found(asset_id, a word's number in column) with the turn that the word has in timed(said).  No join with words: in order of
    their numbers, found meets the beginnings of turns."""
    order = Window.partitionBy("asset_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.size("ws")).over(order), F.lit(0)).cast("int")
    begins = said.withColumn(column, begin).filter(F.size("ws") > 0).select("asset_id", column, F.struct("turn").alias("_turn"))
    both = begins.unionByName(found.withColumn("_found", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("asset_id").orderBy(column, F.col("_found").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("turn", F.last("_turn", ignorenulls=True).over(w)["turn"]).filter("_found").drop("_turn", "_found")


def retaken_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, turn, repeat: whether takes() says the turn's beginning twice."""
    talk = read(spark, sf_dir, "conversations")
    return talk.select(F.col("conv_id").alias("asset_id"), "turn", ((F.col("turn") % 3 == 1) & (F.size(tokens(F.col("text"))) >= 8)).alias("repeat"))
