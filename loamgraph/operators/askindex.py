"""The index that questions are answered from: postings by term, kept up to date with the nodes and read with the terms pushed down.

It is a :class:`VersionedTarget` with the parts ``postings`` (term, id and how often the term stands in name, path and body), ``docs``
(id, path, length of the body, a hash of the content), ``frequencies`` (what each version adds to the number of documents of a term) and ``stats`` (one
row). Files are sorted by term, so a question reads the row groups of its own terms and nothing else, however large the corpus.
A question that finds the table's files changed takes in the nodes that are new, changed or gone, and no others.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.functions.text import query_terms, tokens
from loamgraph.operators.incremental import VersionedTarget
from loamgraph.operators.textsearch import K1, B, rank_factor
from loamgraph.session import materialize, shared_dir

FIELDS = {"n": "name", "p": "path", "b": "body_text"}


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a table's files: names, sizes and times."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(folder, True)
    seen = [path]
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


class AskIndex:
    def __init__(self, target: VersionedTarget):
        self.target = target

    @classmethod
    def of(cls, spark: SparkSession, table_path: str, nodes: DataFrame) -> "AskIndex":
        """The index of a table as it is now. ``nodes`` has id, name, path, body_text, an id once."""
        name = hashlib.sha256(table_path.encode()).hexdigest()[:24]
        index, state = cls(VersionedTarget(spark, f"{shared_dir(spark)}/ask-index-{name}")), state_of(spark, table_path)
        log = index.target.log()
        if not log or log[-1]["note"]["state"] != state:
            index.refresh(nodes, state)
        return index

    def docs(self) -> DataFrame | None:
        """id, path, dl, hash of every document in the index, and ``v``, the version that holds its postings."""
        rows = self.target.read_all("docs", numbered="v")
        if rows is not None and len(self.target.log()) > 1:
            rows = rows.groupBy("id").agg(F.max_by(F.struct("path", "dl", "hash", "there", "v"), "v").alias("d")).select("id", "d.*")
        return rows if rows is None else rows.where("there").drop("there")

    def refresh(self, nodes: DataFrame, state: str = "") -> int:
        """Take in the nodes that are new or changed, and take out those that are gone; returns the version published."""
        now = nodes.select("id", "path", *[F.col(c).alias(f) for f, c in FIELDS.items() if f != "p"], F.xxhash64("name", "path", "body_text").alias("hash"))
        held = self.docs()
        gone = None if held is None else held.join(now.select("id"), "id", "left_anti")
        changed = now if held is None else now.join(held.select("id", "hash"), ["id", "hash"], "left_anti")
        none = F.array().cast("array<string>")
        bags = changed.select("id", "path", "hash", F.coalesce(tokens("n"), none).alias("n"), F.coalesce(tokens("path"), none).alias("p"), F.coalesce(tokens("b"), none).alias("b"))
        bags = materialize(bags, "bags")  # texts are tokenised once, for the postings and for the lengths

        def marked(field: str):
            return F.transform(field, lambda t: F.struct(t.alias("term"), F.lit(field).alias("f")))

        each = bags.select("id", F.explode(F.concat(*map(marked, FIELDS))).alias("t")).select("id", "t.*")
        postings = each.groupBy("term", "id").agg(*[F.count_if(F.col("f") == f).cast("int").alias(f) for f in FIELDS]).sortWithinPartitions("term")
        folder = self.target.stage("postings", postings)
        new = bags.select("id", "path", F.size("b").alias("dl"), "hash", F.lit(True).alias("there"))
        more = self.target.spark.read.parquet(f"{self.target.root}/{folder}").groupBy("term").agg(F.count("*").alias("df"))
        after = new
        if held is not None:
            out = materialize(gone.select("id", "path", "hash").unionByName(held.join(bags.select("id"), "id", "left_semi").select("id", "path", "hash")), "taken-out")
            less = self.postings().join(out.select("id"), "id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
            more = more.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
            after = held.select("id", "dl").join(out.select("id"), "id", "left_anti").unionByName(new.select("id", "dl"))
            new = new.unionByName(gone.select("id", "path", F.lit(0).alias("dl"), "hash", F.lit(False).alias("there")))
        stats = after.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("body"))
        return self.target.publish({"postings": folder, "docs": new, "frequencies": more.sortWithinPartitions("term"), "stats": stats}, {"state": state})

    def postings(self, where=None) -> DataFrame:
        """term, id, n, p, b, path, dl of the documents that are in the index."""
        rows = self.target.read_all("postings", numbered="v")
        return (rows if where is None else rows.where(where)).join(self.docs().drop("hash"), ["id", "v"]).drop("v")

    def lexical(self, question: str) -> DataFrame:
        """id, name_score, path_score, body_score, lexical of every document with a positive total: the scores of
        :func:`textsearch.lexical_scores`, from the postings of the question's terms."""
        words = query_terms(question)
        hit = F.col("term").isin(words) if words else F.lit(False)
        stats = self.target.read("stats")  # one row; of the frequencies there are as many as the question has terms
        df = self.target.read_all("frequencies").where(hit).groupBy("term").agg(F.sum("df").alias("df"))
        idf = df.join(F.broadcast(stats)).select("term", F.log(1 + F.col("n_docs") / (1 + F.col("df"))).alias("idf"))
        rows = self.postings(hit).join(F.broadcast(idf), "term").join(F.broadcast(stats))
        norm = F.when(F.col("body") > 0, F.col("dl") / (F.col("body") / F.col("n_docs"))).otherwise(F.lit(1.0))
        bm25 = F.col("idf") * (F.col("b") * (K1 + 1) / (F.col("b") + K1 * (1 - B + B * norm)))
        sums = rows.groupBy("id", "path").agg((3 * F.sum(F.col("n") * F.col("idf"))).alias("name_score"), (2 * F.sum(F.col("p") * F.col("idf"))).alias("path_score"), F.sum(bm25).alias("body_score"))
        total = (F.col("name_score") + F.col("path_score") + F.col("body_score")) * rank_factor("path", question)
        return sums.select("id", "name_score", "path_score", "body_score", total.alias("lexical")).where("lexical > 0")
