"""Canonical exact digests of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import join_counted, small, stash

#: Rows of one ordered slice, when neighbours by id are sought.
SLICE_ROWS = 200_000


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, then runs of white space (Unicode's) folded to one space and trimmed. Null: empty."""
    t = F.coalesce(text, F.lit(""))
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(t), F.lit(True)))
    plain = F.octet_length(t) == F.length(t)  # ASCII: lower() does the same
    return F.trim(F.regexp_replace(F.when(plain, F.lower(t)).otherwise(folded), r"[\s\p{Z}\x85]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits as 32 hex digits: two XXH64 with different seeds."""
    part = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed).cast("long"), canon))), 16, "0")
    return F.concat(part(0x51ED270B), part(0x2545F491))


def successors(ids: DataFrame) -> DataFrame:
    """doc_id, next_id for distinct ids: the next larger one; after the last comes the first. A null id counts as the largest.

    The ids are dealt out by range, so that the neighbours of nearly all of them are in the same slice; only the first id of each slice
    goes through one small window.
    """
    spark = ids.sparkSession
    n = ids.count()
    ids = ids.select("doc_id", F.col("doc_id").isNull().alias("_null"))
    slices = max(1, -(-n // SLICE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stash(ids.repartitionByRange(slices, "_null", "doc_id").withColumn("_slice", F.spark_partition_id()), "id-slices")
    heads = dealt.groupBy("_slice").agg(F.min(F.struct("_null", "doc_id")).alias("_head"))
    ahead, whole = Window.partitionBy(F.lit(0)).orderBy("_slice"), Window.partitionBy(F.lit(0))
    heads = heads.select("_slice", F.coalesce(F.lead("_head").over(ahead), F.min("_head").over(whole)).alias("_after"))
    within = F.lead(F.struct("_null", "doc_id")).over(Window.partitionBy("_slice").orderBy("_null", "doc_id"))
    near = dealt.select("doc_id", "_slice", within.alias("_within"))
    return near.join(F.broadcast(heads), "_slice").select("doc_id", F.coalesce("_within", "_after")["doc_id"].alias("next_id"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document's (all, if it has
    fewer). A fingerprint is the wide hash of the canonical text. Inside a bucket of equal hashes the canonical texts are compared byte
    by byte, the smallest with the largest; where these differ, texts other than the smallest get their SHA-256 appended, so that equal
    fingerprints mean equal canonical texts. A bucket is reduced in the tasks that hold its rows, and its rows stay where they are.
    The edited text is compared so with its own document's. Likeness is 1.0 for equal fingerprints, else 0.0: an exact digest knows no
    degrees.

    Rows with the same id are all followed by the same next document, of which the smallest beginning counts if its id repeats. Null
    text counts as empty, a null id as the largest. Whole texts cross the network once; beyond that go only the beginnings that are put
    elsewhere and one text for each bucket and task. Extra columns are left out.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    hashed = wide_hash(canonical(F.col("text")))
    slim = stash(docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), hashed.alias("hash")), "digests")
    shared = stash(slim.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("hash").alias("_h"), "_n"), "shared-digests")
    several = join_counted(slim.select("doc_id", "hash"), shared, {"hash": "_h"}, "_n", slim.count()).select("doc_id", F.lit(True).alias("_shared"))
    ids = slim.select("doc_id", "n_chars", F.lit(None).cast("boolean").alias("_shared")).unionByName(several, allowMissingColumns=True)
    ids = stash(ids.groupBy("doc_id").agg(F.max("n_chars").alias("_longest"), F.max("_shared").alias("_shared")), "digest-ids")
    next_of = successors(slim.select("doc_id").distinct()).withColumnRenamed("doc_id", "_id")
    asked = ids.join(next_of, F.col("doc_id").eqNullSafe(F.col("_id"))).select("next_id", F.col("doc_id").alias("_prev"), F.floor(F.col("_longest") / 4).cast("int").alias("_need"))
    asked = stash(asked, "beginnings-asked")

    given = docs.join(asked, F.col("doc_id").eqNullSafe(F.col("next_id"))).select(
        "_prev", F.struct(F.substr("text", F.lit(1), F.col("_need")).alias("start"), hashed.alias("hash")).alias("_next")
    )
    given = given.groupBy("_prev").agg(F.min("_next").alias("_next"))
    about = given.join(ids.select("doc_id", "_shared"), F.col("_prev").eqNullSafe(F.col("doc_id"))).drop("doc_id")
    rows = docs.join(about, F.col("doc_id").eqNullSafe(F.col("_prev")))
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("_next.start", F.lit(1), cut))
    rows = rows.select("doc_id", "text", "_next", "_shared", edited.alias("_edited"), canonical(F.col("text")).alias("_canon"), canonical(edited).alias("_edited_canon"))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"), wide_hash(F.col("_canon")).alias("hash"),
        wide_hash(F.col("_edited_canon")).alias("_edited_hash"), (F.col("_canon") == F.col("_edited_canon")).alias("_same"), F.col("_next.hash").alias("_next_hash"),
        F.when(F.col("_shared"), F.col("_canon")).alias("_canon"),
    )
    rows = stash(rows, "digest-rows")

    # Buckets of unlike texts. None is expected; however many there are, their hashes are joined.
    unlike = rows.where("_canon is not null").groupBy(F.col("hash").alias("_h")).agg(F.min("_canon").alias("_first"), F.max("_canon").alias("_last")).where("_first <> _last")
    unlike = small(stash(unlike.select("_h", "_first"), "unlike-texts"), 1000)
    done = rows.join(unlike, F.col("hash") == F.col("_h"), "left")
    done = done.withColumn("_mark", F.when(F.col("_h").isNull() | (F.col("_canon") == F.col("_first")), "").otherwise(F.concat(F.lit("-"), F.sha2(F.encode("_canon", "UTF-8"), 256))))
    own = F.concat("hash", "_mark")
    other = F.when(F.col("_same"), own).when(F.col("_edited_hash") == F.col("hash"), F.concat("_edited_hash", F.lit("-e"))).otherwise(F.col("_edited_hash"))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return done.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), other.alias("edited_fingerprint"), one(F.col("_same")).alias("near_edited"), one(own == F.col("_next_hash")).alias("near_next"))
