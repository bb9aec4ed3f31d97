r"""WARC archives: written as text by Spark's own writer, read back by boundary-chain verification.

Writing: each row is one record, an HTTP message around the payload. Of equal payloads of at least
MIN_REVISIT bytes, the row with the largest id is the response and the others are revisits of it, whose
blocks hold the HTTP header alone.

Reading: tasks split the files at every occurrence of the magic `WARC/1.`, in payloads too, and emit for
each that begins a record the offset at which that would end. Following these successors from the start
of each file reaches the true records alone. Inside a split, tasks follow them to the offset where the
chain leaves the split. The offsets that a chain can enter a split by are few; over them, pointer jumping
doubles the steps in each round. A record whose payload holds the magic is put together again from its
pieces. Revisits take length, digest and payload from the record that WARC-Refers-To names.

Edge cases: a null payload is an empty one; a null id or url is left out of the record and read back as
null, an empty url as an empty one; a url with white space, controls or characters beyond ASCII is
percent-encoded in its field, and stands in a field of its own in Base64, so that it is read back exactly;
rows that repeat an id and a payload which is the largest id's are each a response, and rows that also
repeat the url are one record written again, with one record id; a revisit of a record
that the archive lacks keeps what its own header says, without a payload; a length or page id beyond 18 digits or
64 bits, and what is no Base64, count as absent; a record that its file's end cuts off is none; an empty table gives an empty
archive; files without records, and bytes behind the last true record, give nothing. Versions 1.0 and 1.1
are read. Header fields end with a carriage return and a line feed, and with nothing else. Other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import write_out

MAGIC = b"WARC/1."
MIN_REVISIT = 1000
MOST_DIGITS = 18
#: Repeated payloads whose digests take up to this many bytes are broadcast; more of them are joined by digest.
BROADCAST_BYTES = 8 << 20
CELL = 1 << 20


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(value): the text of one record a row, without its last line feed."""
    p = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    p = p.withColumns({"digest": F.sha1(F.col("body").cast("binary")), "size": F.octet_length("body")})
    groups = p.filter(F.col("size") >= MIN_REVISIT).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "url")).alias("first"))
    groups = groups.filter("n > 1").select(F.col("digest").alias("of"), F.col("size").alias("first_size"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    groups = write_out(groups, "payloads")
    bounded = groups.select(F.sum(100 + F.coalesce(F.octet_length("first_url"), F.lit(0)))).first()[0] or 0
    same = (F.col("digest") == F.col("of")) & (F.col("size") == F.col("first_size"))
    if bounded <= BROADCAST_BYTES:
        p = p.join(F.broadcast(groups), same, "left")
    else:
        # Digests meet without their payloads; a payload then meets its own verdict by id, so a payload of very many pages is no hot key.
        told = p.select("id", "digest", "size").distinct().join(groups.hint("merge"), same).select(F.col("id").alias("told_id"), "of", "first_size", "first_id", "first_url")
        told = write_out(told, "verdicts")
        p = p.join(told.hint("merge"), F.col("id").eqNullSafe(F.col("told_id")) & same, "left")
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("first_id")) & F.col("of").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    plain = F.col("url").rlike(r"^[\x21-\x7E]*$")
    # url_encode is for forms: it also encodes what may stand, but harms nothing, as the exact one has its own field.
    head = F.concat(
        F.concat(F.lit(MAGIC.decode()), F.lit("0\r\n")),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Record-ID", _uuid(F.col("id"), F.col("url"), F.col("digest"))),
        field("WARC-Target-URI", F.when(plain, F.col("url")).otherwise(F.url_encode("url"))),
        field("X-Target-URI-Base64", F.when(~plain, F.regexp_replace(F.base64(F.col("url").cast("binary")), r"\s", ""))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", F.when(revisit, _uuid(F.col("first_id"), F.col("first_url"), F.col("digest")))),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("X-Page-Id", F.col("id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block),
        F.lit("\r\n\r\n"),
    )
    return p.select(F.concat(head, block, F.lit("\r\n\r")).alias("value"))


def write_warc(pages: DataFrame, path: str, **names: str) -> None:
    """Write an archive of a file per partition; Spark's commit keeps files of lost tasks out."""
    records(pages, **names).write.option("lineSep", "\n").text(path)


_VERSION = re.compile(rb"[0-9]+\r\n")
_NAME = re.compile(r"[A-Za-z0-9-]+\Z")
_FIELDS = ("record_type", "record_id", "url", "page_id", "refers_to_id", "payload_bytes", "payload_digest", "payload")
_FOUND = "record_type string, record_id string, url string, page_id long, refers_to_id string, payload_bytes long, payload_digest string, payload binary"
# kind 0: all bytes of a split (in size); 1: a piece of the file from one magic to the next.
_PIECE = f"file string, block long, kind int, at long, size long, successor long, complete boolean, {_FOUND}, raw binary"
_FOUND_ARROW = [("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("successor", pa.int64()), ("complete", pa.bool_()), *_FOUND_ARROW, ("raw", pa.binary())])
#: Bytes of payloads and pieces in one batch of the scan, and one record beyond.
BATCH_BYTES = 8 << 20


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by name in lower case, the first of each name; lines end with CR LF only, white space is space and tab."""
    out: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon and _NAME.match(name):
            out.setdefault(name.lower(), value.strip(" \t"))
    return out


def _number(said: str) -> int | None:
    """A decimal of at most 18 digits, so that offsets stay within 64 bits; what is longer is none."""
    digits = said.removeprefix("-")
    if not (digits.isascii() and digits.isdigit()) or len(digits := digits.lstrip("0")) > MOST_DIGITS:
        return None
    return int(digits or "0") * (-1 if said.startswith("-") else 1)


def _length(fields: dict[str, str]) -> int | None:
    size = _number(fields.get("content-length", ""))
    return size if size is not None and size >= 0 else None


def _exact(said: str | None) -> str | None:
    """The text that a field has in Base64, or None if there is no such field or no Base64 in it."""
    try:
        return None if said is None else base64.b64decode(said, validate=True).decode("utf-8", "replace")
    except ValueError:
        return None


def _header(piece: bytes) -> tuple[int, int, dict[str, str]] | None:
    """Lengths of the header with its empty line and of the block, and the fields, of what follows a magic."""
    if not _VERSION.match(piece) or (end := piece.find(b"\r\n\r\n")) < 0:
        return None
    fields = _fields(piece[:end])
    length = _length(fields)
    return None if length is None else (end + 4, length, fields)


def _page_id(said: str) -> int | None:
    """A whole number of 64 bits."""
    return n if re.fullmatch(r"-?[0-9]{1,19}", said) and -(1 << 63) <= (n := int(said)) < 1 << 63 else None


def _payload(fields: dict[str, str], block: bytes) -> tuple[int, str, bytes]:
    """The payload's length and digest, and its bytes where the record has them."""
    body = block
    if fields.get("content-type", "").startswith("application/http") and (end := block.find(b"\r\n\r\n")) >= 0:
        body = block[end + 4 :]
        if fields.get("warc-type") == "revisit" and not body and (size := _length(_fields(block[:end]))) is not None:
            return size, fields.get("warc-payload-digest", "").removeprefix("sha1:"), b""
    return len(body), hashlib.sha1(body).hexdigest(), body


def _record(fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    size, digest, body = _payload(fields, block)
    exact = _exact(fields.get("x-target-uri-base64"))
    url = fields.get("warc-target-uri") if exact is None else exact
    return fields.get("warc-type"), fields.get("warc-record-id"), url, _page_id(fields.get("x-page-id", "")), fields.get("warc-refers-to"), size, digest, body if payloads else None


def _scan(raw: bool, payloads: bool):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, at, out, held = None, 0, [], 0
        none = (None,) * len(_FIELDS)
        for given in batches:
            for file, block, value in zip(*(given.column(i) for i in range(3)), strict=True):
                where, piece = (file.as_py(), block.as_py()), value.as_py()
                if where != here:
                    if here is not None:
                        out.append((*here, 0, 0, at, None, None, *none, None))
                    here, at = where, 0
                successor, complete, fields = None, False, none
                if not raw and (found := _header(piece)):
                    head, length, said = found
                    successor = at + head + length + 4
                    if complete := len(piece) == head + length + 4:
                        fields = _record(said, piece[head : head + length], payloads)
                out.append((*where, 1, at - len(MAGIC), len(piece), successor, complete, *fields, piece if raw else None))
                at += len(piece) + len(MAGIC)
                held += len(piece) if raw or payloads else 400
                if held > BATCH_BYTES:
                    yield batch(out)
                    out, held = [], 0
        if here is not None:
            out.append((*here, 0, 0, at, None, None, *none, None))
        if out:
            yield batch(out)

    return scan


def pieces(spark: SparkSession, path: str, raw: bool = False, payloads: bool = False) -> DataFrame:
    """The pieces of all files between magics, with offsets inside their splits.

    Spark's text reader deals the pieces to splits by where the magic in front of them is, so the splits'
    bytes add up to the offsets in the file.
    """
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return text.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary")).mapInArrow(_scan(raw, payloads), _PIECE)


def _splits(scanned: DataFrame) -> DataFrame:
    """(file, block, base, size): where each split's bytes begin in their file, and how many they are."""
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return scanned.filter("kind = 0").select("file", "block", F.coalesce(F.sum("size").over(order), F.lit(0)).alias("base"), "size")


def _placed(scanned: DataFrame) -> DataFrame:
    """Pieces with offsets in their files, of what _scan has written."""
    base = _splits(scanned).drop("size")
    found = scanned.filter("kind = 1").join(base.hint("merge"), ["file", "block"])
    return found.withColumns({"at": F.col("at") + F.col("base"), "successor": F.col("successor") + F.col("base")}).drop("base", "kind").filter("at >= 0")


def _exits(pdf):
    """Of a split's candidates: where the chain that begins at each leaves the split."""
    pdf = pdf.sort_values("at")
    exits: dict[int, int] = {}
    for at, nxt in zip(pdf["at"].tolist()[::-1], pdf["successor"].tolist()[::-1], strict=True):
        exits[at] = exits.get(nxt, nxt)
    return pdf[["file", "at"]].assign(to=[exits[a] for a in pdf["at"].tolist()])


def _walk(pdf):
    """Of a split's candidates those on the chain from its entry."""
    succ = dict(zip(pdf["at"].tolist(), pdf["successor"].tolist(), strict=True))
    on = set()
    for at in pdf.loc[pdf["entry"], "at"].tolist():
        while at in succ and at not in on:
            on.add(at)
            at = succ[at]
    return pdf.loc[pdf["at"].isin(on), ["file", "at"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, block, at, successor) on the chain from the start of their file."""
    exits = write_out(candidates.groupBy("file", "block").applyInPandas(_exits, "file string, at long, to long"), "exits")
    # A split is entered at its file's start or where another's chain leaves: few of the candidates are such.
    heads = exits.select("file", F.col("to").alias("at")).distinct()
    jumps = exits.filter("at = 0").union(exits.filter("at > 0").join(heads.hint("merge"), ["file", "at"], "left_semi"))
    nodes = jumps = write_out(jumps, "jumps")
    reached = write_out(jumps.filter("at = 0").select("file", "at"), "reached")
    while not jumps.isEmpty():
        step = reached.join(jumps.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at")).join(nodes.select("file", "at").hint("merge"), ["file", "at"], "left_semi")
        further = jumps.select(F.col("file").alias("in"), F.col("at").alias("via"), F.col("to").alias("end"))
        ahead = jumps.join(further.hint("merge"), (F.col("file") == F.col("in")) & (F.col("to") == F.col("via"))).select("file", "at", F.col("end").alias("to"))
        reached, jumps = write_out(reached.union(step).distinct(), "reached"), write_out(ahead, "jumps")
    entries = reached.select("file", "at", F.lit(True).alias("entry"))
    marked = candidates.join(entries.hint("merge"), ["file", "at"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "block").applyInPandas(_walk, "file string, at long")


def _whole(payloads: bool):
    def whole(rows):
        """Put a record's pieces together; rows: (file, start, successor, at, raw)."""
        rows = rows.sort_values("at")
        data = MAGIC.join(rows["raw"].tolist())[: int(rows["successor"].iloc[0] - rows["start"].iloc[0]) - len(MAGIC)]
        head, length, fields = _header(data)
        values = dict(zip(_FIELDS, ([x] for x in _record(fields, data[head : head + length], payloads)), strict=True))
        return rows.iloc[:1][["file"]].assign(at=rows["start"].iloc[0], **values).astype({"page_id": "Int64"})

    return whole


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(file, at, record_type, record_id, url, page_id, refers_to, payload_bytes, payload_digest, payload) of all true records.

    refers_to is the page of the record that a revisit names, and its payload is that record's. payloads=False reads none.
    """
    scanned = write_out(pieces(spark, path, payloads=payloads), "pieces")
    placed = _placed(scanned)
    candidates = placed.filter("successor is not null").select("file", "block", "at", "successor")
    true = write_out(reachable(candidates), "records")
    found = placed.join(true.hint("merge"), ["file", "at"])
    done = found.filter("complete").select("file", "at", *_FIELDS)
    splits = _splits(scanned)
    # The splits' bytes count a magic behind the last piece too. A block that goes on behind its file's end is none; the line ends behind it may lack.
    ends = splits.groupBy("file").agg((F.max(F.col("base") + F.col("size")) - len(MAGIC) + 4).alias("end"))
    torn = found.filter("not complete").select("file", F.col("at").alias("start"), "successor").join(ends.hint("merge"), "file").filter(F.col("successor") <= F.col("end"))
    torn = write_out(torn.drop("end"), "torn")
    if not torn.isEmpty():
        # A piece lies in few cells and so does a record: the join is on the file and the cell, never on the file alone.
        cells = torn.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor(F.col("successor") / CELL))))
        # Of the archive only the pieces in such cells are written again, known by offsets inside their splits.
        held = splits.select("file", "block", "base", F.explode(F.sequence(F.floor(F.greatest(F.col("base") - len(MAGIC), F.lit(0)) / CELL), F.floor((F.col("base") + F.col("size")) / CELL))).alias("cell"))
        inside = held.join(cells.select("file", "cell").distinct().hint("merge"), ["file", "cell"])
        local = inside.select("file", "block", "base", F.explode(F.sequence(F.floor((F.col("cell") * CELL - F.col("base")) / CELL), F.floor(((F.col("cell") + 1) * CELL - 1 - F.col("base")) / CELL))).alias("near")).distinct()
        local = write_out(local, "cells")
        small = local.count() * 300 <= BROADCAST_BYTES
        raw = pieces(spark, path, raw=True).filter("kind = 1").withColumn("near", F.floor(F.col("at") / CELL)).join(F.broadcast(local) if small else local.hint("merge"), ["file", "block", "near"])
        parts = write_out(raw.select("file", (F.col("at") + F.col("base")).alias("at"), "raw"), "raw").withColumn("cell", F.floor(F.col("at") / CELL))
        torn_parts = cells.join(parts.hint("merge"), ["file", "cell"]).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("successor")))
        whole = torn_parts.select("file", "start", "successor", "at", "raw").groupBy("file", "start").applyInPandas(_whole(payloads), f"file string, at long, {_FOUND}")
        done = done.unionByName(whole)
    done = write_out(done, "found")
    named = write_out(done.filter("refers_to_id is not null").select(F.col("refers_to_id").alias("rid")).distinct(), "named")
    # One record for each name; of those that repeat a name any will do, as they are equal.
    first = [F.any_value(c).alias(f"of_{c}") for c in ("page_id", "payload_bytes", "payload_digest", "payload")]
    of = done.filter("refers_to_id is null").join(named.hint("merge"), F.col("record_id") == F.col("rid"), "left_semi").groupBy(F.col("record_id").alias("rid")).agg(*first)
    small = not payloads and named.count() * 160 <= BROADCAST_BYTES
    out = done.join(F.broadcast(of) if small else of.hint("merge"), F.col("refers_to_id") == F.col("rid"), "left")
    take = lambda c: F.when(F.col("rid").isNull(), F.col(c)).otherwise(F.col(f"of_{c}")).alias(c)
    return out.select("file", "at", "record_type", "record_id", "url", "page_id", F.col("of_page_id").alias("refers_to"), *map(take, ("payload_bytes", "payload_digest", "payload")))
