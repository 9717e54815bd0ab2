"""WARC archives with revisits: written by Spark, read back by length, resolved by payload digest.

Archives go through Spark's text writer, whose line separator (CR LF) ends each record, so files
are committed as any table is and may lie in any store that Spark reaches.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, nothing_held, table

#: Smallest payload, in bytes, that a revisit record may stand for.
LEAST = 100
#: Bytes of payload that one archive file holds on average, at most.
ARCHIVE_BYTES = 8_000_000
#: Ways that copies of one payload are dealt before they meet their original's header.
SALTS = 16
#: Capture date of the records where none is given: archives must come out alike on a rerun.
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"


def headers(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """id, payload_bytes, payload_digest, record_type and refers_to of each page, without the payloads.

    Of records with equal payloads of at least `least` bytes the one with the smallest id is the
    response and the others revisit it; smaller payloads are all responses. Rows that repeat the
    smallest id are all responses; a null id comes after every other one. A null payload is empty.
    The digests' smallest ids are aggregated before they are shuffled, and joined to the slim headers.
    """
    return _headers(pages, least, id_col, None, payload_col).select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _headers(pages: DataFrame, least: int, id_col: str, url_col: str | None, payload_col: str) -> DataFrame:
    """headers() under fixed names, with the pages' urls and the original's (refers_url).

    Only digests that occur more than once are joined, each dealt SALTS ways; payloads under `least` bytes meet nothing.
    """
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    slim = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    large = slim.where(F.col("payload_bytes") >= least)
    original = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "url"))
    first = large.groupBy("payload_digest").agg(original.alias("first"), F.count("*").alias("copies")).where("copies > 1")
    first = first.select(F.col("payload_digest").alias("f_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"))
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")
    joined = large.withColumn("salt", salt).join(first, (F.col("payload_digest") == F.col("f_digest")) & (F.col("salt") == F.col("f_salt")), "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    found = joined.select(
        "id", "url", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"),
    )
    kinds = dict(found.dtypes)
    none = lambda name: F.lit(None).cast(kinds[name]).alias(name)
    small = slim.where(F.col("payload_bytes") < least).select("id", "url", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), none("refers_to"), none("refers_url"))
    return found.unionByName(small)


def _clean(c: Column) -> Column:
    """A header's value: control signs are percent-encoded, so that it stays on its line."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _urn(row_id: Column, digest: Column) -> Column:
    """A name-based record id: the same for the same page on every run."""
    h = F.sha2(F.concat_ws(":", row_id.cast("string"), digest), 256)  # a null id is left out
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(pages: DataFrame, files: int, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> DataFrame:
    """One string `record` per page: fresh WARC headers, fresh HTTP headers, and the payload unless it revisits.

    The headers of revisits are joined back to the pages on id, digest and url; rows equal in these
    are equal in what the join adds, which is made distinct first. Both sides are dealt by a hash of
    the three into `files` partitions, so that payloads move once and copies don't meet in one task.
    """
    told = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    # One key that is never null: the join takes the rows as they are dealt by it.
    key = lambda i, u, d: F.sha2(F.concat_ws("\n", F.col(d), F.length(told(i)).cast("string"), told(i), told(u)), 256)
    head = _headers(pages, least, id_col, url_col, payload_col).where("record_type = 'revisit'")
    head = head.groupBy(key("id", "url", "payload_digest").alias("h_key")).agg(F.any_value("refers_to").alias("refers_to"), F.any_value("refers_url").alias("refers_url"))
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("p_id"), F.col(url_col).cast("string").alias("p_url"), body.alias("p_body"), F.sha2(body.cast("binary"), 256).alias("p_digest"))
    rows = rows.withColumn("p_key", key("p_id", "p_url", "p_digest"))
    rows = rows.repartition(files, "p_key").join(head.repartition(files, "h_key").hint("shuffle_hash"), F.col("p_key") == F.col("h_key"), "left")
    revisit = F.col("h_key").isNotNull()
    size = F.octet_length("p_body").cast("string")
    block = F.concat(F.lit(_HTTP), F.lit("Content-Length: "), size, F.lit(CRLF + CRLF), F.when(revisit, "").otherwise(F.col("p_body")))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(CRLF))
    return rows.withColumn("__block", block).select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}"),
            line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            line("WARC-Record-ID", _urn(F.col("p_id"), F.col("p_digest"))),
            line("WARC-Date", F.lit(date)),
            line("WARC-Target-URI", _clean(F.col("p_url"))),
            line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("p_digest"))),
            F.when(F.col("p_id").isNotNull(), line("X-Row-Id", _clean(F.col("p_id")))).otherwise(""),
            F.when(
                revisit,
                F.concat(
                    line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                    line("WARC-Refers-To", _urn(F.col("refers_to"), F.col("p_digest"))),
                    line("WARC-Refers-To-Target-URI", _clean(F.col("refers_url"))),
                    line("WARC-Refers-To-Date", F.lit(date)),
                    line("X-Refers-To-Row-Id", _clean(F.col("refers_to"))),
                ),
            ).otherwise(""),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("__block").cast("string")),
            F.lit(CRLF), F.col("__block"), F.lit(CRLF),
        ).alias("record")
    )


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns) -> None:
    """Writes the pages' deduplicated archives into the folder path, gzip files of about archive_bytes unpacked each.

    An empty table leaves a folder without records.
    """
    payload = columns.get("payload_col", "html")
    total = pages.agg(F.sum(F.octet_length(F.col(payload).cast("string")) + 1024)).first()[0] or 0
    records(pages, max(1, -(-total // archive_bytes)), **columns).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def plain(value: str | None) -> str | None:
    """A header's value as it was before _clean()."""
    return value and value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def parse(raw: bytes) -> list[tuple]:
    """(type, row id, refers-to row id, uri, digest of the header, length of the header, payload or None) of each record."""
    out, at = [], 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = {k.decode(): v.decode() for k, v in (x.split(b": ", 1) for x in lines[1:])}
        start = end + 4
        at = start + int(head["Content-Length"])
        body = raw.index(b"\r\n\r\n", start) + 4
        said = int(raw[raw.rindex(b": ", start, body) + 2 : body - 4])
        kind = head["WARC-Type"]
        out.append((kind, head.get("X-Row-Id"), head.get("X-Refers-To-Row-Id"), head["WARC-Target-URI"], head["WARC-Payload-Digest"].removeprefix("sha256:"), said, raw[body:at] if kind == "response" else None))
        at += 4
    return out


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives under path: record_type, row_id, refers_to, uri, header_digest, header_bytes,
    then digest and bytes as recomputed from the payload (null for revisits), and the payload itself if asked for.

    A record is cut out by its Content-Length, whatever its payload holds. A file is read whole by a
    task; write() bounds files' sizes.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    fields = ["record_type", "row_id", "refers_to", "uri", "header_digest", "header_bytes", "digest", "bytes"] + ["payload"] * payloads
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    schema = "record_type string, row_id string, refers_to string, uri string, header_digest string, header_bytes long, digest string, bytes long" + ", payload binary" * payloads

    def run(batches):
        nothing_held()
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for kind, row, to, uri, digest, said, payload in parse(gzip.decompress(batch.column(0)[i].as_py())):
                    own = (None, None) if payload is None else (hashlib.sha256(payload).hexdigest(), len(payload))
                    rows.append((kind, plain(row), plain(to), plain(uri), digest, said, *own, *[payload] * payloads))
                for at in range(0, len(rows), 512):
                    columns = list(zip(*rows[at : at + 512], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], fields)

    return files.mapInArrow(run, schema)


def resolve(found: DataFrame) -> DataFrame:
    """read()'s records with every revisit joined to its original response by digest and id: digest, bytes (and payload) filled in.

    A revisit whose original is missing keeps nulls there.
    """
    extra = ["payload"] if "payload" in found.columns else []
    revisits = found.where(F.col("record_type") == "revisit")
    own = found.where(F.col("record_type") == "response")
    wanted = revisits.select("refers_to", "header_digest").distinct()
    originals = own.join(wanted.select(F.col("refers_to").alias("w_id"), F.col("header_digest").alias("w_digest")), (F.col("row_id") == F.col("w_id")) & (F.col("digest") == F.col("w_digest")), "left_semi")
    originals = originals.select(F.col("row_id").alias("o_id"), F.col("digest").alias("o_digest"), F.col("bytes").alias("o_bytes"), *[F.col(c).alias(f"o_{c}") for c in extra]).dropDuplicates(["o_id", "o_digest"])
    joined = revisits.join(originals, (F.col("refers_to") == F.col("o_id")) & (F.col("header_digest") == F.col("o_digest")), "left")
    filled = joined.select("record_type", "row_id", "refers_to", "uri", "header_digest", "header_bytes", F.col("o_digest").alias("digest"), F.col("o_bytes").alias("bytes"), *[F.col(f"o_{c}").alias(c) for c in extra])
    return own.unionByName(filled)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    write(pages, path)
    kind = dict(pages.dtypes)["page_id"]
    return resolve(read(spark, path, payloads=False)).select(
        F.col("row_id").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


QUERIES = {"op8_warc_revisits": query}
SQL = {
    "op8_warc_revisits": """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
h as (select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from h)
select page_id, payload_bytes, payload_digest,
       case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when first_id is not null and page_id <> first_id then first_id end as refers_to
from f
""",
}
