"""Operator 4: metadata and plain-text conversion records from WARC responses.

Every response gives a ``metadata`` record that refers to it, with the source's WARC and HTTP headers, title and links, and
every response that is text also a ``conversion`` record with its plain text. Their identifiers are
derived from the source's, so a repeated task makes the same records.

A page is read in time that grows with its length, whatever it holds: quoted attribute values are minded within TAG_WINDOW characters of
a tag's beginning, and a tag that is not closed there ends at the next ``>``.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What may open a comment, another declaration or a tag.
OPEN = re.compile(r"<(?:(!--)|[!?]|/?[a-zA-Z])")
COMMENT_END = re.compile(r"--!?>")
#: A tag: quoted attribute values may hold ``>``; a quote that is never closed counts as a plain character.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
TAG_WINDOW = 1024
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
#: The candidates of a ``srcset``.
CANDIDATE = re.compile(r"(?:^|,)\s*+([^\s,]\S*)")
#: Content of this many bytes and more is not unpacked.
MAX_CONTENT = 256 << 20
#: Elements without visible text; of the first two, not even tags count inside.
RAW, HIDDEN = ("script", "style"), ("noscript", "template", "svg")
BREAKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table thead tbody section article nav header footer main aside blockquote pre form head body html br hr".split())
LINKED = frozenset("a area link img script iframe source video audio embed form".split())
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r?\n")
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
OUT = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("n_links", pa.int64()), ("record", pa.binary())])


def digest(data: bytes) -> str:
    """A WARC digest: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_list(block: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and fields of a header block in order, equal names each; names in lower case, continuation lines joined."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", block).decode("utf-8", "replace").splitlines()
    pairs = [line.partition(":") for line in lines[1:]]
    return (lines[0] if lines else ""), [(name.strip().lower(), value.strip()) for name, colon, value in pairs if colon]


def headers(block: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields of a header block for look-ups: the last of equal names wins."""
    first, fields = header_list(block)
    return first, dict(fields)


def all_values(fields: list[tuple[str, str]]) -> dict[str, str | list[str]]:
    """Each name with its value, or with the list of its values in order where it is repeated."""
    found: dict[str, list[str]] = {}
    for name, value in fields:
        found.setdefault(name, []).append(value)
    return {name: values if len(values) > 1 else values[0] for name, values in found.items()}


def unchunked(payload: bytes) -> bytes:
    """A chunked payload's content; what is no chunk (a capture that was stored without chunks) stays as it is."""
    parts, at = [], 0
    while m := CHUNK.match(payload, at):
        size = int(m[1], 16)
        parts.append(payload[m.end() : m.end() + size])
        at = m.end() + size
        if not size or at >= len(payload):
            return b"".join(parts)
        at += 2 if payload[at : at + 2] == b"\r\n" else payload[at : at + 1] == b"\n"
    return b"".join(parts) + payload[at:]


class TooLong(ValueError):
    """Unpacked content of more than MAX_CONTENT bytes."""


def inflated(payload: bytes, coding: str) -> bytes:
    """A gzip, deflate or zstd payload's content, of a broken one as much as can be read; other bytes stay as they are."""
    if coding == "zstd":
        return _zstd(payload)
    raw = coding == "deflate" and (len(payload) < 2 or payload[0] & 15 != 8 or int.from_bytes(payload[:2], "big") % 31)
    if coding != "deflate" and payload[:2] != b"\x1f\x8b":
        return payload
    out, rest, size = [], payload, 0
    while rest:  # gzip may have several members
        member = zlib.decompressobj(-15 if raw else 47)
        try:
            for a in range(0, len(rest), 65536):
                out.append(member.decompress(rest[a : a + 65536]))
                if (size := size + len(out[-1])) > MAX_CONTENT:
                    raise TooLong
                if member.eof:
                    rest = member.unused_data + rest[a + 65536 :]
                    break
            else:
                out.append(member.flush())
                break
        except zlib.error:
            break
        if coding == "deflate":
            break
    return b"".join(out) if any(out) or not payload else payload


def _zstd(payload: bytes) -> bytes:
    if payload[:4] != b"\x28\xb5\x2f\xfd":
        return payload
    out = bytearray()
    try:
        with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(payload, read_across_frames=True) as source:
            while part := source.read(1 << 20):
                out += part
                if len(out) > MAX_CONTENT:
                    raise TooLong
    except zstandard.ZstdError:
        pass
    return bytes(out) or payload


def content(payload: bytes, fields: list[tuple[str, str]]) -> tuple[bytes, str | None]:
    """The payload without its transfer and content codings, the last applied undone first, and the coding that could not be undone, if any."""
    codings = lambda name: [c.strip().lower() for n, v in fields if n == name for c in v.split(",")]
    for coding in [*reversed(codings("transfer-encoding")), *reversed(codings("content-encoding"))]:
        if coding == "chunked":
            payload = unchunked(payload)
        elif coding in ("gzip", "x-gzip", "deflate", "zstd"):
            payload = inflated(payload, coding)
        elif coding not in ("", "identity", "none", "utf-8"):
            return payload, coding
    return payload, None


def split_block(data: bytes) -> tuple[bytes, bytes]:
    """Headers and body around the first empty line."""
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[: m.start()], data[m.end() :]) if m else (data, b"")


def decode(payload: bytes, content_type: str) -> str:
    """Text of a payload in the charset that HTTP or the page's first KB names, else UTF-8; bad bytes become U+FFFD."""
    m = CHARSET.search(content_type.encode()) or CHARSET.search(payload[:1024])
    try:
        return payload.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _end(page: str, name: str, at: int) -> tuple[int, int]:
    """Where the first closing tag ``name`` after ``at`` begins and ends; the page's end if there is none."""
    m = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    return m.span() if m else (len(page), len(page))


def read_page(page: str, base: str) -> tuple[str, list[dict[str, str]], str | None]:
    """Visible text, links and title of a page, tag by tag.

    Text: hidden elements and comments out, a line for each block element, entities resolved. Links in order, absolute where
    they can be joined to the page's first ``<base href>`` or else to ``base``, also those of hidden elements; data, mail and ``javascript:`` links, comments and the code
    of scripts are left out.
    """
    text, links, title, hidden, at, own_base = [], [], None, None, 0, None
    last = page.rfind(">")
    while opened := OPEN.search(page, at):
        if opened[1]:
            if not hidden:
                text += [page[at : opened.start()], " "]
            ended = COMMENT_END.search(page, opened.end())
            at = ended.end() if ended else len(page)
            continue
        begin = opened.start()
        if begin > last:
            break  # no tag from here on is closed
        if not hidden:
            text.append(page[at:begin])
        m = TAG.match(page, begin, min(len(page), begin + TAG_WINDOW)) or PLAIN_TAG.match(page, begin)
        if not m:  # a declaration
            at = page.index(">", begin) + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name == hidden:
                hidden = None
                text.append(" ")
            elif not hidden and name in BREAKS:
                text.append("\n")
            continue
        if name in LINKED:
            found = [(a.lower(), next(filter(None, values), "")) for a, *values in ATTRIBUTE.findall(m[3])]
            links += [{"path": f"{name.upper()}@/{a}", "url": v} for a, v in found if a in ("href", "src", "action") and v][:1]
            links += [{"path": f"{name.upper()}@/srcset", "url": u} for a, v in found if a == "srcset" for u in CANDIDATE.findall(v)]
        elif name == "base" and own_base is None:
            own_base = next((v for a, *values in ATTRIBUTE.findall(m[3]) if a.lower() == "href" for v in values if v), None)
        if name in RAW:
            at = _end(page, name, at)[1]
            text.append(" ")
        elif name == "title" and not hidden:
            begin, (stop, at) = at, _end(page, name, at)
            title = page[begin:stop] if title is None else title
            text += ["\n", page[begin:stop], "\n"]
        elif name in HIDDEN and not hidden and not m[3].rstrip().endswith("/"):
            hidden = name
        elif not hidden and name in BREAKS:
            text.append("\n")
    if not hidden:
        text.append(page[at:])
    plain = LINES.sub("\n", BLANKS.sub(" ", html.unescape("".join(text)))).strip()
    base = _joined(base, html.unescape(own_base).strip()) if own_base else base
    return plain, [x for x in (_absolute(x, base) for x in links) if x], None if title is None else " ".join(html.unescape(title).split())


def _joined(base: str, url: str) -> str:
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def _absolute(link: dict[str, str], base: str) -> dict[str, str] | None:
    """A link joined to ``base``; None for one that leads to no other page."""
    url = html.unescape(link["url"]).strip()
    if not url or url.lower().startswith(("javascript:", "data:", "mailto:", "#")):
        return None
    return {"path": link["path"], "url": _joined(base, url)}


def page_text(page: str) -> str:
    """The text of ``read_page``."""
    return read_page(page, "")[0]


def page_links(page: str, base: str) -> list[dict[str, str]]:
    """The links of ``read_page``."""
    return read_page(page, base)[1]


def record(kind: str, source: dict[str, str], content_type: str, body: bytes) -> tuple[str, str, bytes]:
    """Identifier, block digest and bytes of a record that refers to ``source``."""
    refers = source.get("warc-record-id", "")
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers}#{kind}')}>"
    block = digest(body)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", source.get("warc-date", "")), ("WARC-Target-URI", source.get("warc-target-uri", "")), ("WARC-Refers-To", refers), ("WARC-Block-Digest", block), ("Content-Type", content_type), ("Content-Length", str(len(body)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v)
    return name, block, head.encode("utf-8", "replace") + b"\r\n" + body + b"\r\n\r\n"


def kind_of(status: str, content_type: str, payload: bytes) -> tuple[str | None, str | None]:
    """``html`` or ``plain`` for a response that is text, else None and the reason.

    By the stated media type; without one, a payload that begins with ``<`` is HTML.
    """
    code = status.split(" ")[1:2]
    if code and code[0].isdigit() and not code[0].startswith("2"):
        return None, f"status {code[0]}"
    media = content_type.partition(";")[0].strip().lower()
    if media in ("text/html", "application/xhtml+xml"):
        return "html", None
    if media.startswith("text/"):
        return "plain", None
    if not media and (payload[:256].lstrip()[:1] == b"<" or not payload):
        return "html", None
    return None, f"media type {media or 'unknown'}"


def converted(status: str, http_fields: list[tuple[str, str]], payload: bytes, target: str) -> tuple[str | None, list[dict[str, str]], str | None, str | None]:
    """Text, links and title of a payload; no text, and the reason, where it is not text or cannot be unpacked."""
    content_type = dict(http_fields).get("content-type", "")
    try:
        body, left = content(payload, http_fields)
    except TooLong:
        return None, [], None, f"content over {MAX_CONTENT} bytes"
    if left is not None:
        return None, [], None, f"coding {left}"
    kind, reason = kind_of(status, content_type, body)
    if kind is None:
        return None, [], None, reason
    page = decode(body, content_type)
    return (*read_page(page, target), None) if kind == "html" else (page.strip(), [], None, None)


def derive(data: bytes | None) -> list[tuple]:
    """Rows of OUT for one record; none if it is null or no response."""
    head, rest = split_block(data or b"")
    _, source_fields = header_list(head)
    source = dict(source_fields)
    if source.get("warc-type") != "response":
        return []
    size = source.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    http_head, payload = split_block(block)
    status, http_fields = header_list(http_head)
    own = digest(payload)
    stated = source.get("warc-payload-digest")
    target = source.get("warc-target-uri", "")
    text, links, title, reason = converted(status, http_fields, payload, target)
    about = {
        "source": all_values(source_fields),
        "http": {"status": status, "headers": all_values(http_fields)},
        "payload_digest": {"stated": stated, "computed": own, "length": len(payload)},
        "html": {"title": title, "links": links},
    }
    common = (source.get("warc-record-id"), target or None, source.get("warc-date"), stated or own)
    rows = []
    if text is not None:
        plain = text.encode("utf-8", "replace")
        made = record("conversion", source, "text/plain; charset=utf-8", plain)
        rows.append(("conversion", made[0], *common, made[1], len(plain), 0, made[2]))
        about["conversion"] = made[0]
    else:
        about |= {"conversion": None, "not_converted": reason}
    told = json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    described = record("metadata", source, "application/json", told)
    return [("metadata", described[0], *common, described[1], len(told), len(links), described[2]), *rows]


def build_derivatives(responses: DataFrame, record_col: str = "record", id_col: str | None = None) -> DataFrame:
    """A metadata row for each response record in ``record_col``, and a conversion row for each that is text: ``[id_col,] warc_type, record_id, refers_to, target_uri, warc_date, payload_digest, block_digest, content_length, n_links, record``.

    ``payload_digest`` is the one the source states, else a computed one; the metadata body holds
    both. Null records and other record types give no rows; an empty payload gives empty text. HTML (also XHTML) of a 2xx response is read as a page and
    other text/* taken as it is; of other media types and statuses, codings that cannot be undone (br) and content over MAX_CONTENT bytes
    there is no conversion, and the metadata says why. Missing headers stay out, and a repeated header's
    values are a list; chunked, gzip, deflate and zstd payloads are decoded (digests are of the stored bytes); repeated records give the same records again. Other columns are not
    read. No shuffle: each record is derived where it is read.
    """
    names = [f.name for f in OUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                made = [(i, row) for i, data in enumerate(part.column(0).to_pylist()) for row in derive(data)]
                columns = [pa.array([row[k] for _, row in made], f.type) for k, f in enumerate(OUT)]
                ids = [part.column(1).take(pa.array([i for i, _ in made], pa.int64()))] if id_col else []
                yield pa.record_batch(ids + columns, names=([id_col] if id_col else []) + names)

    kind = f"`{id_col}` {dict(responses.dtypes)[id_col]}, " if id_col else ""
    kinds = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, payload_digest string, block_digest string, content_length long, n_links long, record binary"
    columns = [F.col(record_col).cast("binary").alias("record")] + ([F.col(id_col)] if id_col else [])
    return responses.select(*columns).mapInArrow(run, kind + kinds)


def base32_sha1(data: Column) -> Column:
    """The form of ``digest`` in DataFrame functions: every five hexadecimal places are four in base 32."""
    places = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*places), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def response_record(page_id: Column, url: Column, page: Column) -> Column:
    """A page as a WARC response record (binary); identifier and date are derived from id and URL."""
    body = F.coalesce(page.cast("binary"), F.lit(b""))
    name = F.md5(F.concat_ws("|", page_id.cast("string"), url))
    part = lambda a, n: F.substring(name, a, n)
    urn = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.crc32(name), F.lit(365)).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: "), urn, F.lit("\r\nWARC-Date: "), day, F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: "), base32_sha1(body), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(body) + F.octet_length(http)).cast("string"), F.lit("\r\n\r\n"), http,
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as responses, and what is derived from them, without the bytes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    responses = pages.select("page_id", response_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    return build_derivatives(responses, id_col="page_id").drop("record")
