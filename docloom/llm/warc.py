"""WARC archives without repeated payloads.

Headers alone (id, digest, size, address) are shuffled by payload digest to find each payload's original, the record
with the largest id; the others become revisit records that name it. Records get fresh headers, with the time of
writing unless told otherwise, and are written by Spark's text sink, so output goes wherever Spark can write, and a lost
executor's file is written again.

Archives are bounded by bytes: payloads are written by classes of size, each with so many records a file that their
payloads stay below ``FILE_BYTES``, or one record a file if it is longer by itself. Spark's sink compresses a file as
one gzip member. Reading unpacks an archive piece by piece, follows each record's Content-Length, recomputes size and
digest from the payload, and joins revisits to their responses by record id: a task holds a compressed archive, one
record, and a batch of about ``BATCH_BYTES`` of records. Archives of a gzip member a record are read likewise.

Payloads are text columns written as UTF-8. Only revisit decisions are joined to the payloads' rows; where they are
few Spark broadcasts them by its size check, and payloads stay where they are.

Defined results: a null payload is the empty one; a null or empty address leaves its header out, and line breaks in
an address are percent-encoded; payloads shorter than ``least_bytes`` are all responses; null ids count as the
smallest and stay null; of rows that repeat both id and payload of an original one is the response and the others
revisit it, so that each payload is written once; an empty table writes no record and reads as empty. Other columns
aren't read, so they can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.arrow import quoted
from docloom.session import materialise, new_path, ship_package

#: Payload bytes of an archive at most, unless one payload is longer; records of an archive at most.
FILE_BYTES, FILE_ROWS = 32 << 20, 4096
#: Classes of payloads by size: up to so many bytes each, and the rest.
CLASSES = (FILE_BYTES // FILE_ROWS, FILE_BYTES // 128, FILE_BYTES // 4)
#: Records are handed on in batches of about so many payload bytes; archives are unpacked in pieces of so many.
BATCH_BYTES, PIECE = 4 << 20, 1 << 18
END = "\r\n"
#: Names and forms of the WARC 1.1 standard, and the alphabet of base 32.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Extension field that carries a row's own id through an archive.
ID_FIELD = "X-Row-ID"


def base32(hex_digits: Column) -> Column:
    """Upper-case base 32 of 40 hex digits (no padding is needed for 160 bits)."""
    letters = []
    for group in range(4):
        bits = F.conv(F.substring(hex_digits, 1 + 10 * group, 10), 16, 10).cast("long")
        for k in range(8):
            letters.append(F.substr(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def _uuid(row_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(row_id.cast("string"), F.lit("null")), digest))
    part = lambda start, length: F.substring(h, start, length)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def revisits(headers: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """From headers (id, digest, size, uri): what each repeated payload's other records refer to, and the tied originals.

    The first has id, digest and the original's id and uri; the second the digest, id and uri of originals of which
    there are several rows: all but one of these rows, ``others``, are revisits too.
    """
    rank = F.struct(F.col("id").isNotNull().alias("known"), "id", "uri")
    each = headers.where(F.col("size") >= least_bytes).groupBy("digest", "id", "uri").agg(F.count("*").alias("n"))
    original = each.groupBy("digest").agg(F.max(rank).alias("o"), F.sum("n").alias("n"))
    original = original.where("n > 1").select("digest", F.col("o.id").alias("original_id"), F.col("o.uri").alias("original_uri"))
    met = materialise(each.join(original, "digest"), "repeated")
    same = F.col("id").eqNullSafe(F.col("original_id"))
    repeated = met.where(~same).select("id", "digest", "original_id", "original_uri").dropDuplicates(["id", "digest"])
    tied = met.where(same).withColumn("others", F.col("n") - F.when(F.col("uri") == F.col("original_uri"), 1).otherwise(0))
    tied = tied.withColumn("rows", F.sum("n").over(Window.partitionBy("digest"))).where("rows > 1")
    return repeated, tied.select("digest", "id", "uri", "others", "original_uri")


def record_text(date: str) -> Column:
    """A record without its closing line breaks, from id, uri, payload, size, digest, revisit and the original's columns."""
    revisit = F.col("revisit")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    with_uri = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", line(name, F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("size").cast("string")), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit(VERSION + END),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(revisit, F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(_uuid(F.col("id"), F.col("digest")))),
        line("WARC-Date", F.lit(date)),
        with_uri("WARC-Target-URI", F.col("uri")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", _uuid(F.col("original_id"), F.col("digest"))), with_uri("WARC-Refers-To-Target-URI", F.col("original_uri")), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        F.when(F.col("id").isNotNull(), line(ID_FIELD, F.col("id").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
        block,
    )


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str | None = None) -> None:
    """One record per row, each payload of at least ``least_bytes`` written once. Archives lie in folders of ``path``, one a class of sizes."""
    date = date or now()
    payload = F.coalesce(quoted(payload_col), F.lit(""))
    rows = pages.select(quoted(id_col).alias("id"), F.coalesce(quoted(url_col), F.lit("")).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", base32(F.sha1("payload")))
    headers = materialise(rows.select("id", "digest", "size", "uri"), "headers")
    repeated, tied = revisits(headers, least_bytes)
    found = materialise(repeated, "revisits").withColumnRenamed("id", "r_id").withColumnRenamed("digest", "r_digest")
    tied = materialise(tied, "tied")
    sizes = headers.groupBy(size_class(F.col("size")).alias("class")).agg(F.count("*").alias("n")).collect()  # a row a class

    def write(records: DataFrame, name: str, file_rows: int) -> None:
        records.select(record_text(date).alias("value")).write.mode("append").option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", file_rows).text(f"{path}/{name}")

    has_ties = tied.limit(1).count() > 0
    of_response = {"revisit": F.lit(False), "original_id": F.lit(None).cast(rows.schema["id"].dataType), "original_uri": F.lit(None).cast("string")}
    own = rows
    if has_ties:
        names = materialise(tied.select(F.col("digest").alias("t_digest"), F.col("id").alias("t_id")).distinct(), "tied-ids")
        is_tied = (F.col("digest") == F.col("t_digest")) & F.col("id").eqNullSafe(F.col("t_id"))
        own = rows.join(names, is_tied, "left_anti")
        # One payload each, combined before it is shuffled; the other rows need no payload.
        first = rows.join(names, is_tied, "left_semi").groupBy("digest").agg(F.first("id").alias("id"), F.max("uri").alias("uri"), F.first("payload").alias("payload"), F.first("size").alias("size"))
        others = tied.where("others > 0").join(headers.select("digest", "size").distinct(), "digest")
        others = others.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("others"))), "digest", "id", "uri", F.lit("").alias("payload"), "size", F.lit(True).alias("revisit"), F.col("id").alias("original_id"), "original_uri")
        write(others, "revisits", FILE_ROWS)
    for at in sorted(r["class"] for r in sizes) or [0]:
        file_rows = FILE_BYTES // CLASSES[at] if at < len(CLASSES) else 1
        part = own.where(size_class(F.col("size")) == at) if len(sizes) > 1 else own
        joined = part.join(found, (F.col("digest") == F.col("r_digest")) & F.col("id").eqNullSafe(F.col("r_id")), "left")
        write(joined.withColumn("revisit", F.col("r_digest").isNotNull()), f"class-{at}", file_rows)
        if has_ties:
            write(first.where(size_class(F.col("size")) == at).withColumns(of_response), f"class-{at}", file_rows)


def size_class(size: Column) -> Column:
    out: Column = F.when(size <= CLASSES[0], 0)
    for at, most in enumerate(CLASSES[1:], 1):
        out = out.when(size <= most, at)
    return out.otherwise(len(CLASSES))


def pieces(archive: memoryview) -> Iterator[bytes]:
    """The bytes of an archive, gzipped in one member or many or not at all, piece by piece."""
    if bytes(archive[:2]) != b"\x1f\x8b":
        for at in range(0, len(archive), PIECE):
            yield bytes(archive[at : at + PIECE])
        return
    rest = archive
    while len(rest):
        unpack = zlib.decompressobj(wbits=31)
        while not unpack.eof:
            if not len(rest) and not unpack.unconsumed_tail:
                raise ValueError("the archive ends inside a gzip member")
            given = unpack.unconsumed_tail or bytes(rest[:PIECE])
            if given is not unpack.unconsumed_tail:
                rest = rest[PIECE:]
            yield unpack.decompress(given, PIECE)
        left = len(unpack.unused_data)
        rest = archive[len(archive) - len(rest) - left :] if left else rest


def parse(archive: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive. Holds one record and one piece at a time."""
    held, source = bytearray(), pieces(memoryview(archive))

    def fill(until: int) -> bool:
        while len(held) < until:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while held or fill(1):
        seen = 0
        while (head := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("the archive ends inside a record's header")
        version, *lines = held[:head].decode("utf-8").split(END)
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record where one begins: {version[:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines)
        start = head + 4
        end = start + int(fields["Content-Length"])
        if not fill(end):
            raise ValueError(f"the archive ends inside {fields.get('WARC-Record-ID')}")
        yield fields, bytes(held[start:end])
        fill(end + 4)
        del held[: end + 4]


READ_SCHEMA = "row_id string, record_id string, record_type string, uri string, date string, digest string, refers_to_record string, bytes long, payload string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record of all archives in ``path`` and its folders. Digest and size of responses are recomputed from the payload, and the digest is verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x, pa.int64() if x == "bytes" else pa.string()) for x in ("row_id", "record_id", "record_type", "uri", "date", "digest", "refers_to_record", "bytes", "payload")])
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for fields, block in parse(memoryview(archive.as_buffer())):
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = text = None
                    if kind == "response":
                        body = memoryview(block)[block.index(b"\r\n\r\n") + 4 :]
                        size = len(body)
                        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']} doesn't fit its payload")
                        text = str(body, "utf-8") if payloads else None
                        held += size if payloads else 0
                    rows.append((fields.get(ID_FIELD), fields["WARC-Record-ID"], kind, fields.get("WARC-Target-URI"), fields.get("WARC-Date"), digest, fields.get("WARC-Refers-To"), size, text))
                    if held > BATCH_BYTES or len(rows) >= FILE_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ship_package(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return found.select("content").mapInArrow(run, READ_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """Records with, for revisits, the row id, size and payload of the response to which they refer."""
    plain = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string")).drop("refers_to_record")
    other = records.where("record_type <> 'response'").drop("bytes", "payload")
    wanted = other.select(F.col("refers_to_record").alias("record_id")).distinct()
    responses = records.where("record_type = 'response'").join(wanted, "record_id", "left_semi")
    responses = responses.groupBy("record_id").agg(F.any_value(F.struct("row_id", "bytes", "payload")).alias("original"))
    joined = other.join(responses.withColumnRenamed("record_id", "refers_to_record"), "refers_to_record", "left")
    resolved = joined.select("row_id", "record_id", "record_type", "uri", "date", "digest", F.col("original.bytes").alias("bytes"), F.col("original.payload").alias("payload"), F.col("original.row_id").alias("refers_to"))
    return plain.unionByName(resolved)


def op9_revisit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    write_archives(pages, path)
    records = materialise(read_archives(spark, path, payloads=False), "records")
    return resolve(records).select(
        F.col("row_id").cast("long").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP9_SQL = f"""
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
coded AS (
  SELECT page_id, payload_bytes,
         list_reduce(list_transform(range(32), lambda i: substr('{BASE32}', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT, 1)), lambda a, b: a || b) AS payload_digest
  FROM hashed),
originals AS (SELECT payload_digest, max(page_id) AS original FROM coded GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM original THEN NULL ELSE original END AS refers_to
FROM coded JOIN originals USING (payload_digest)
"""
