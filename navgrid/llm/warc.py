"""WARC archives of pages, and reading them back by verified boundary chains.

Writing: one record per page. Of equal payloads the one with the smallest page_id is a response, the others are revisits
that refer to it and carry no payload.

Reading: tasks read byte ranges and cut them at every occurrence of the record magic, also those inside payloads. Each
piece that looks like a record names its successor: its own offset plus header and content length. Pieces of a split that
follow each other directly are one run, so runs end only at splits and at payloads that hold magic. Starting with the first
byte of each file, pointer jumping over runs keeps what the chain of records reaches; all other magic lies inside a payload,
and the pieces it cut are joined again. Only lengths and headers are shuffled, and payloads that hold magic. Pieces are
numbered in one written scan; a second scan looks up the pieces of torn records by length and two hashes of their content,
so it does not matter how either scan splits the files. A piece or a revisit's response that is not found fails the job.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from navgrid.llm.common import bounded
from navgrid.session import discard, materialise, shared_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BROADCAST_ROWS = 100_000
CELL = 1 << 20  # bytes of a file that pieces and torn records are matched by
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, path: str, smallest: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archive pages (page_id, url, html) in a folder that does not exist yet; each file holds what one task read.

    A null html is an empty payload, a null url leaves out the target, a null page_id writes an empty id. Payloads under
    `smallest` bytes are always responses, and so are all rows that share the smallest page_id of their payload.
    """
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    known = materialise(page.where(F.col("bytes") >= smallest).select("page_id", "digest"))
    first = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = first.where("first is not null").select(F.col("digest").alias("of"), "first")
    revisits = F.broadcast(revisits) if bounded(revisits, BROADCAST_ROWS) else revisits
    page = page.join(revisits, (page.digest == F.col("of")) & (page.bytes >= smallest), "left")
    again = F.col("first").isNotNull() & ~page.page_id.eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", clean), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Refers-To", _urn(F.col("first"))), line("WARC-Profile", F.lit(REVISIT)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    page.select(record.alias("value")).write.option("lineSep", END).text(path)
    discard(known)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files in the folder: file, offset, length, type, id, refers_to, target, payload_bytes,
    payload_digest (of what the record holds: null for revisits), stated_digest (of its header). A broken
    file ends at its last complete record.

    Payload is what follows the HTTP header of the block, or the whole block if it is no HTTP message.
    """
    source = (spark.read.option("lineSep", MAGIC).text(path)
              .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
              .withColumn("at", F.monotonically_increasing_id()))
    head = F.substring_index("value", END, 1)
    header = F.concat(F.lit("\r\n"), head)
    field = lambda name: F.nullif(F.regexp_extract(header, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    pieces = source.select(
        "file", "split", "at", *_content(F.col("value")),
        F.when(F.instr("value", END) > 0, F.octet_length(head) + 4).cast("long").alias("header"),
        F.expr("try_cast(%s as long)" % "nullif(regexp_extract(concat('\\r\\n', substring_index(value, '\\r\\n\\r\\n', 1)), "
               "'(?i)\\\\r\\\\nContent-Length:[ \\\\t]*([0-9]{1,18})[ \\\\t]*(\\\\r\\\\n|$)', 1), '')").alias("content"),
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("refers_to"),
        field("WARC-Target-URI").alias("target"), field("WARC-Payload-Digest").alias("stated_digest"), "value")
    block = F.substring(F.col("value").cast("binary"), (F.col("header") + 1).cast("int"), F.col("content").cast("int"))
    whole = F.col("header") + F.col("content") + 4 <= F.col("n")
    pieces = materialise(pieces.withColumns({f"_{k}": F.when(whole, v) for k, v in _payload(block).items()}).drop("value"))
    offsets = materialise(_offsets(pieces))
    records = materialise(offsets.join(_few(_reached(offsets)), ["file", "run"]).where("offset >= entry"))
    torn = records.where("payload_digest is null")
    done = records.where("payload_digest is not null").select(*_OUT)
    if torn.limit(1).count():
        done = done.unionByName(_rejoined(source, offsets, torn))
    return done.withColumns({x: F.when(F.col("type") != "revisit", F.col(x)) for x in ("payload_bytes", "payload_digest")})


_OUT = ["file", "offset", "length", "type", "id", "refers_to", "target", "stated_digest", "payload_bytes", "payload_digest"]


def _payload(block: Column) -> dict[str, Column]:
    """Payload of a record's block (binary)."""
    text = block.cast("string")
    skip = F.when(text.startswith("HTTP/") & (F.instr(text, END) > 0),
                  F.octet_length(F.substring_index(text, END, 1)) + 4).otherwise(0)
    payload = F.substring(block, (skip + 1).cast("int"), F.octet_length(block))
    return {"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)}


def _offsets(pieces: DataFrame) -> DataFrame:
    """Where each piece's magic starts in its file, and where its successor would start.

    ``run`` is the offset of the first of the pieces of a split that name each other in order up to this one, null for pieces
    that are no record; ``last`` marks the run's end."""
    magic = len(MAGIC)
    splits = (pieces.groupBy("file", "split").agg(F.sum(F.col("n") + magic).alias("size"))
              .selectExpr("file", "split", "sum(size) over (partition by file order by split) - size as before"))
    order = Window.partitionBy("file", "split").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside, record = F.col("inside"), F.col("length").isNotNull()
    placed = (pieces.withColumn("inside", F.sum(F.col("n") + magic).over(so_far) - F.col("n") - 2 * magic)
              .withColumn("length", F.lit(magic) + F.col("header") + F.col("content") + 4)
              .withColumn("linked", record & F.lag(inside + F.col("length")).over(order).eqNullSafe(inside))
              .withColumn("head", F.when(record, F.max(F.when(record & ~F.col("linked"), inside)).over(so_far)))
              .withColumn("last", record & ~F.lead("linked", 1, False).over(order)))
    offset = F.col("before") + inside
    return (placed.join(splits, ["file", "split"]).withColumn("offset", offset)
            .select("file", "split", "at", "offset", "length", (offset + F.col("length")).alias("next"), (F.col("before") + F.col("head")).alias("run"),
                    "last", "type", "id", "n", "hash", "more", "refers_to", "target", "stated_digest", F.col("_payload_bytes").alias("payload_bytes"),
                    F.col("_payload_digest").alias("payload_digest")))


def _few(rows: DataFrame) -> DataFrame:
    """Named for a broadcast if there are few, otherwise for sort and merge."""
    return rows.hint("broadcast" if bounded(rows, BROADCAST_ROWS) else "merge")


def _reached(offsets: DataFrame) -> DataFrame:
    """Runs (file, run) that the chain of records from byte 0 of each file goes through, and the offset ``entry`` from which on
    it does: a false record may lead into a run of true ones. Pointers from run to run are squared in every round, so rounds
    grow with the logarithm of the runs of a file. A chain only goes forward and meets a run once."""
    places = offsets.where("run is not null")
    exits = _few(offsets.where("last").select("file", "run", "next"))
    jump = materialise(places.select("file", F.col("offset").alias("next"), F.col("run").alias("to")).join(exits, ["file", "next"])
                       .select("file", "run", "to", F.col("next").alias("entry")))
    reached, n = materialise(places.where("offset = 0").select("file", "run", F.col("offset").alias("entry"))), 0
    while (count := reached.count()) > n:
        n, step = count, _few(jump)
        further = reached.select("file", "run").join(step, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        grown = materialise(reached.unionByName(further))
        twice = jump.select("file", "run", F.col("to").alias("mid")).join(
            step.select("file", F.col("run").alias("mid"), "to", "entry"), ["file", "mid"])
        squared = materialise(twice.select("file", "run", "to", "entry"))
        discard(reached, jump)
        reached, jump = grown, squared
    discard(jump)
    return reached


def _content(value: Column) -> list[Column]:
    """What a piece is known by: its length and two hashes."""
    return [F.octet_length(value).cast("long").alias("n"), F.xxhash64(value).alias("hash"), F.xxhash64(F.lit(7), value).alias("more")]


def _rejoined(source: DataFrame, offsets: DataFrame, torn: DataFrame) -> DataFrame:
    """Records whose payload holds magic: their pieces, in order, with the magic between them.

    Pieces meet their record by equal cells of the file, as many as the record touches. A record past the file's end is
    incomplete and left out."""
    of = torn.select("file", F.col("offset").alias("of"), "length", "type", "id", "refers_to", "target", "stated_digest")
    cell = lambda x: F.floor(x / CELL)
    touched = of.select("file", "of", "length", F.explode(F.sequence(cell(F.col("of")), cell(F.col("of") + F.col("length") - 1))).alias("cell"))
    parts = (offsets.select("file", "offset", cell(F.col("offset")).alias("cell"), "n", "hash", "more").join(touched, ["file", "cell"])
             .where((F.col("offset") >= F.col("of")) & (F.col("offset") < F.col("of") + F.col("length"))))
    parts = materialise(parts.select("file", "of", "offset", "n", "hash", "more"))
    content = ["n", "hash", "more"]
    wanted = parts.select(*content).distinct()
    wanted = F.broadcast(wanted) if bounded(wanted, BROADCAST_ROWS) else wanted
    values = source.select("value", *_content(F.col("value"))).join(wanted, content, "left_semi").groupBy(*content).agg(F.first("value").alias("value"))
    lost = F.raise_error(F.concat(F.lit("A piece of an archive was not found again: "), "file", F.lit(" "), F.col("offset").cast("string")))
    texts = (parts.join(values, content, "left").withColumn("value", F.when(F.col("value").isNull(), lost).otherwise(F.col("value")))
             .groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts")))
    text = F.concat_ws(MAGIC, F.transform("parts", lambda x: x["value"]))
    whole = texts.select("file", "of", text.alias("text"))
    header = F.octet_length(F.substring_index("text", END, 1)) + 4
    joined = whole.join(of, ["file", "of"])
    block = F.substring(F.col("text").cast("binary"), (header + 1).cast("int"),
                        (F.col("length") - len(MAGIC) - header - 4).cast("int"))
    complete = F.octet_length("text") >= F.col("length") - len(MAGIC)
    return (joined.where(complete).withColumnRenamed("of", "offset").withColumns(_payload(block)).select(*_OUT))


def archived_pages(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """Pages written to archives in the shared folder and read back: one row per record, revisits with the payload
    length and digest of the response that they refer to; of several with its page_id, the one of the digest that the
    revisit states. A count of records read back that differs from that of pages is an error. Columns: page_id,
    payload_bytes, payload_digest, record_type, refers_to.
    See write_archives for nulls and ties; an empty table gives no rows."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/navgrid/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, smallest)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as long)")
    records = materialise(read_archives(spark, path).select(
        number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        number("refers_to").alias("refers_to"), F.regexp_replace("stated_digest", "^sha256:", "").alias("stated")))
    read, written = records.count(), pages.count()
    if read != written:
        raise RuntimeError(f"{written} pages were archived and {read} records read back")
    responses = records.where("record_type = 'response' and payload_bytes >= %d" % smallest).groupBy(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated")).agg(F.max("payload_bytes").alias("n"))
    lost = F.raise_error(F.concat(F.lit("The response of a revisit is not in the archives: "), F.col("refers_to").cast("string")))
    again = records.where("record_type = 'revisit'").join(responses, ["refers_to", "stated"], "left").select(
        "page_id", F.when(F.col("n").isNull(), lost).otherwise(F.col("n")).alias("payload_bytes"), F.col("stated").alias("payload_digest"),
        "record_type", "refers_to")
    return records.where("record_type = 'response'").drop("stated").unionByName(again)
