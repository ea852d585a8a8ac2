"""The store of evidence: six tables of fixed schema, each a folder of Parquet versions.

A write makes a new version and then a numbered commit file that lists the version's files and their lengths. A commit's number can be
taken once, so of two writers one starts again from what the other wrote. Readers take the greatest commit that is whole: one that
is still being written, or whose files are missing or cut short, is passed over for the one before it, and a table without any
is empty. The last versions are kept for readers that still hold them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators.graphs import cut

SCHEMAS = {
    "sources": "id string, url string, domain string, kind string, credibility int, signals_json string, is_primary int, published_at long, wayback_first_seen long, fetched_via string, fetched_at long",
    "docs": "id string, source_id string, sha256 string, text string, slop_score int, slop_json string",
    "claims": "id string, text string, normalized string, volatility string, first_seen long, last_verified long, verdict string, confidence double, ics int",
    "evidence": "claim_id string, doc_id string, quote string, char_start int, char_end int, anchor_kind string, entail string, entail_score double",
    "lineage": "from_doc string, to_doc string, kind string, score double",
    "runs": "id string, question string, mode string, started long, finished long, status string, report_json string",
}


def replace_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both; a new row replaces the old ones of its key, and of new rows of one key, the greatest stays. Rows with a null key
    are all kept."""
    kept = old.join(new.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*new.columns)
    keyed = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*(c for c in new.columns if c != key))).alias("r"))
    fresh = keyed.select(*(key if c == key else f"r.{c}" for c in new.columns))
    return kept.unionByName(fresh).unionByName(new.filter(F.col(key).isNull()))


def claim_rows(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the claims table from incoming (id, text, verdict, confidence, ics, now): the time of first sight is kept by normalized
    text, from existing rows or the earliest incoming one. Rows without an id or a text are left out; others all stay, those whose
    text has no letter or digit among them.

    The normalized texts are written before they are joined, as two evaluations of one expression need not agree: the optimizer may
    rewrite one side of a join and not the other.
    """
    rows = cut(incoming.filter("id is not null and text is not null and id <> '' and text <> ''").withColumn("normalized", T.normalize_claim(F.col("text"))))
    seen = existing.select("normalized", "first_seen").unionByName(rows.select("normalized", F.col("now").alias("first_seen"))).groupBy("normalized").agg(F.min("first_seen").alias("first_seen"))
    return rows.join(seen, "normalized", "left").select(
        "id", "text", "normalized", T.volatility(F.col("text")).alias("volatility"), F.coalesce("first_seen", "now").alias("first_seen"), F.col("now").alias("last_verified"), F.coalesce("verdict", F.lit("UNVERIFIED")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("ics", F.lit(0)).cast("int").alias("ics")
    )


def recall(claims: DataFrame, texts: DataFrame, now: int) -> DataFrame:
    """(text, hit, id, verdict, reason): whether each of texts (text) has a stored claim of the same normalized text that is fresh. Of
    several, the one verified last counts."""
    last = claims.groupBy("normalized").agg(F.max(F.struct("last_verified", "id", "verdict", "volatility")).alias("c"))
    r = texts.select("text", T.normalize_claim(F.col("text")).alias("normalized")).join(last, "normalized", "left")
    fresh = T.is_fresh(F.col("c.last_verified"), F.col("c.volatility"), F.lit(now))
    reason = F.when(F.col("c").isNull(), "miss").when(fresh, "hit").otherwise("stale")
    return r.select("text", (reason == "hit").alias("hit"), F.col("c.id").alias("id"), F.col("c.verdict").alias("verdict"), reason.alias("reason"))


def default_path(home: str) -> str:
    """Where a store lies below a home folder."""
    return f"{home.rstrip('/')}/.quillstone/evidence"


class Store:
    """``keep``: how many versions of each table stay for readers that hold an older one."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def migrated(cls, spark: SparkSession, legacy: str, path: str) -> Store:
        """The store at ``path``; where there is none yet, a copy of the one at ``legacy``, which stays."""
        s = cls(spark, path)
        old, new = s._path(legacy.rstrip("/")), s._path(s.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        source = old.getFileSystem(conf)
        if source.exists(old) and not s._fs.exists(new):
            s._jvm.org.apache.hadoop.fs.FileUtil.copy(source, old, s._fs, new, False, conf)
        return s

    def _known(self, table: str) -> str:
        if table not in SCHEMAS:
            raise ValueError(f"Unknown table: {table}")
        return f"{self.path}/{table}"

    def _listed(self, at: str) -> dict[str, int]:
        """Lengths of the files in a folder; none if it is missing."""
        p = self._path(at)
        return {f.getPath().getName(): f.getLen() for f in self._fs.listStatus(p)} if self._fs.exists(p) else {}

    def _commits(self, at: str) -> list[int]:
        return sorted((int(n[7:]) for n in self._listed(at) if n.startswith("commit-")), reverse=True)

    def _committed(self, at: str, number: int) -> str | None:
        """The version that a commit names, if commit and version are whole."""
        from py4j.protocol import Py4JJavaError

        stream = self._fs.open(self._path(f"{at}/commit-{number:012d}"))
        try:
            said = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except Py4JJavaError as e:
            if "ChecksumException" not in e.java_exception.getClass().getName():
                raise
            return None
        except ValueError:
            return None
        finally:
            stream.close()
        have = self._listed(f"{at}/{said['version']}")
        return said["version"] if all(have.get(n) == size for n, size in said["files"].items()) else None

    def _current(self, table: str) -> tuple[int, DataFrame]:
        at = self._known(table)
        numbers = self._commits(at)
        for n in numbers:
            if (version := self._committed(at, n)) is not None:
                return numbers[0], self.spark.read.schema(SCHEMAS[table]).parquet(f"{at}/{version}")
        return numbers[0] if numbers else 0, self.spark.createDataFrame([], SCHEMAS[table])

    def table(self, table: str) -> DataFrame:
        return self._current(table)[1]

    def find(self, table: str, **where: object) -> DataFrame:
        """Rows whose columns equal the given values; nothing equals null. The tests reach the Parquet scan."""
        df = self.table(table)
        for column, value in where.items():
            df = df.filter(F.col(column) == F.lit(value))
        return df

    def _update(self, table: str, change: Callable[[DataFrame], DataFrame], tries: int = 8) -> None:
        """Writes what ``change`` makes of the table, again from the start where another writer was first."""
        at = self._known(table)
        for _ in range(tries):
            last, old = self._current(table)
            version = f"v-{uuid.uuid4().hex}"
            change(old).write.parquet(f"{at}/{version}")
            said = json.dumps({"version": version, "files": {n: size for n, size in self._listed(f"{at}/{version}").items() if n.endswith(".parquet")}})
            commit = self._path(f"{at}/commit-{last + 1:012d}")
            if self._fs.exists(commit) or not self._create(commit, said):
                self._fs.delete(self._path(f"{at}/{version}"), True)
                continue
            self._clean(at)
            return
        raise RuntimeError(f"other writers were first {tries} times: {table}")

    def _create(self, path, content: str) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            out = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _clean(self, at: str) -> None:
        for n in self._commits(at)[self.keep :]:
            version = self._committed(at, n)
            self._fs.delete(self._path(f"{at}/commit-{n:012d}"), False)
            if version is not None:
                self._fs.delete(self._path(f"{at}/{version}"), True)

    def put(self, table: str, rows: DataFrame) -> None:
        """Adds rows; where the table has an id, rows replace those of theirs, and columns that are left out become null."""
        self._known(table)
        kinds = [f.split() for f in SCHEMAS[table].split(", ")]
        whole = rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds))
        self._update(table, lambda old: replace_rows(old, whole) if "id" in whole.columns else old.unionByName(whole))

    def put_claims(self, incoming: DataFrame) -> None:
        """Adds claims (id, text, verdict, confidence, ics, now); a claim that is known keeps its time of first sight."""

        def change(old: DataFrame) -> DataFrame:
            rows = cut(claim_rows(incoming, old))
            return replace_rows(old, rows.select(*old.columns))

        self._update("claims", change)

    def recall(self, texts: DataFrame, now: int) -> DataFrame:
        return recall(self.table("claims"), texts, now)

    def stats(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in C.TABLES}


def page_documents(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, pos, url, text, snippet_only) for requests (pos, url, snippet) against fetched pages (url, html): one for each url, at its
    first place. A page that is missing or empty is replaced by a snippet of 60 characters or more, and otherwise left out."""
    first = requests.filter("url is not null").groupBy("url").agg(F.min(F.struct("pos", "snippet")).alias("r")).select("url", "r.pos", "r.snippet")
    html = pages.groupBy("url").agg(F.max("html").alias("html"))
    text = T.strip_html(T.clamp(F.col("html")))
    joined = first.join(html, "url", "left").withColumn("page", F.when(F.length(text) > 0, text))
    snippet = F.when(F.length(F.trim("snippet")) >= 60, F.trim("snippet"))
    out = joined.select(T.short_id(F.col("url")).alias("id"), "pos", "url", F.coalesce("page", snippet).alias("text"), F.col("page").isNull().alias("snippet_only"))
    return out.filter("text is not null")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of whole text files, named by their paths."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text"))
