"""Mail archives as a DataFrame: a Python data source with one partition for each stretch of an mbox file.

    spark.dataSource.register(MboxSource)
    spark.read.format("mbox").load("/mail/*.mbox")

Files are split at message boundaries ("\\nFrom ") by bytes, so a large archive is read by many tasks. A stretch belongs
to the partition in which its first byte lies. An index beside the file (<name>.imap, JSON) may give offsets instead.
Options since and until (ISO days, UTC) bound the dates; undated messages go when a bound is given. With an index in
order of time only the stretch within the bounds is read, found by reading a few headers.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import glob
import hashlib
import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime
from email.header import decode_header as _decode_header

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import html_to_text

SCHEMA = (
    "message_id string, in_reply_to string, references array<string>, from_addr string, from_display string, to string, cc string, subject string, "
    "date timestamp, body string, is_html_only boolean, folder string, msg_hash string, headers map<string,string>, attachments array<struct<filename:string,content_type:string,size:bigint>>"
)
SPLIT_BYTES = 64 << 20
#: Date formats tried after the standard one.
DATE_FORMATS = ("%d %b %Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%a %b %d %H:%M:%S %Y")


def decode_words(raw: str | None) -> str:
    """RFC 2047 words as text; unknown charsets fall back to utf-8, then latin-1."""
    out = []
    for part, charset in _decode_header(raw or ""):
        out.append(safe_decode(part, charset) if isinstance(part, bytes) else part)
    return " ".join(x.strip() for x in out if x.strip())


def safe_decode(data: bytes, charset: str | None) -> str:
    for name in (charset, "utf-8"):
        try:
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


def parse_date(raw: str | None) -> datetime | None:
    """A header's date in UTC; without a zone it is taken as UTC."""
    if not raw or not raw.strip():
        return None
    try:
        at = email.utils.parsedate_to_datetime(raw.strip())
    except (TypeError, ValueError):
        at = None
        for f in DATE_FORMATS:
            try:
                at = datetime.strptime(raw.strip(), f)
                break
            except ValueError:
                continue
    if at is None:
        return None
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).astimezone(UTC)


def message_date(message) -> datetime | None:
    tries = [message.get("Date"), message.get("Resent-Date"), *(r.rpartition(";")[2] for r in message.get_all("Received", []))]
    return next((d for d in map(parse_date, tries) if d), None)


def parse(data: bytes, folder: str) -> tuple:
    """One message as a row of SCHEMA."""
    envelope, _, rest = data.partition(b"\n") if data.startswith(b"From ") else (b"", b"", data)
    m = email.message_from_bytes(rest, policy=email.policy.compat32)
    sender = m.get("From") or m.get(">From") or m.get("Return-Path") or envelope.decode("latin-1")[5:].split(" ")[0]
    display, address = email.utils.parseaddr(decode_words(str(sender)))
    plain = html = None
    attachments = []
    for part in m.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        payload = part.get_payload(decode=True) or b""
        if name or part.get_content_disposition() == "attachment":
            attachments.append((decode_words(name), part.get_content_type(), len(payload)))
        elif part.get_content_type() == "text/plain" and plain is None:
            plain = safe_decode(payload, part.get_content_charset())
        elif part.get_content_type() == "text/html" and html is None:
            html = safe_decode(payload, part.get_content_charset())
    at = message_date(m)
    subject = decode_words(str(m.get("Subject", "")))
    ids = lambda name: str(m.get(name, "") or "").replace("\n", " ").split()
    message_id = next(iter(ids("Message-ID")), None)
    key = message_id or subject + (at.isoformat() if at else "")
    return (
        message_id,
        next(iter(ids("In-Reply-To")), None),
        ids("References"),
        address.lower(),
        display,
        decode_words(str(m.get("To", ""))),
        decode_words(str(m.get("Cc", ""))),
        subject,
        at,
        plain if plain is not None else html_to_text(html) or "",
        plain is None and html is not None,
        folder,
        hashlib.sha256(key.encode("utf-8", "replace")).hexdigest()[:12],
        {k.lower(): str(v) for k, v in m.items() if k.lower() in ("list-unsubscribe", "reply-to", "precedence")},
        attachments,
    )


def parsed(rows: DataFrame, key: str, raw: str, folder: str) -> DataFrame:
    """(key, and the columns of SCHEMA): raw messages (binary) that are in a table already."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.replace("struct<filename:string,content_type:string,size:bigint>", "x").split(", ")]
        for batch in batches:
            out = pd.DataFrame([parse(bytes(r), f) for r, f in zip(batch["__raw"], batch["__folder"], strict=True)], columns=names)
            out["date"] = [None if d is None or pd.isna(d) else d.replace(tzinfo=None) for d in out["date"].astype(object)]
            out["attachments"] = [[{"filename": a, "content_type": b, "size": c} for a, b, c in x] for x in out["attachments"]]
            out.insert(0, "__key", batch["__key"].to_numpy())
            yield out

    some = rows.select(F.col(key).alias("__key"), F.col(raw).alias("__raw"), F.col(folder).alias("__folder"))
    return some.mapInPandas(run, f"__key {kind}, {SCHEMA}").withColumnRenamed("__key", key)


def read_index(path: str) -> list[tuple[int, int]] | None:
    """(offset, length) of each message from an index beside the archive: a list, {messages: [...]}, or {uid: entry}."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if isinstance(data, dict):
        data = data["messages"] if "messages" in data else [data[k] for k in sorted((k for k in data if k.isdigit()), key=int)]
    return [(int(e["offset"]), int(e["length"])) for e in data]


def peek_date(f, offset: int, most: int = 1 << 14) -> datetime | None:
    """A message's date from its first bytes: Date, else the envelope line, else Received."""
    f.seek(offset)
    data = f.read(most)
    envelope, _, rest = data.partition(b"\n") if data.startswith(b"From ") else (b"", b"", data)
    m = email.message_from_bytes(rest.partition(b"\n\n")[0] + b"\n\n", policy=email.policy.compat32)
    tries = [m.get("Date"), envelope.decode("latin-1")[5:].partition(" ")[2], *(r.rpartition(";")[2] for r in m.get_all("Received", []))]
    return next((d for d in map(parse_date, tries) if d), None)


def first_from(f, entries: list[tuple[int, int]], at: datetime) -> int:
    """The first entry of an index in order of time that isn't before `at`; undated ones count as before."""
    low, high = 0, len(entries)
    while low < high:
        middle = (low + high) // 2
        date = peek_date(f, entries[middle][0])
        if date is None or date < at:
            low = middle + 1
        else:
            high = middle
    return low


def mail_files(account: str, folders: str | None = None) -> list[str]:
    """Archives below an account's folder, optionally of some folders (by name, comma-separated), each once, sorted."""
    wanted = {x.strip().lower() for x in folders.split(",")} if folders else None
    found = {p for pattern in ("**/*.mbox", "**/mbox") for p in glob.glob(os.path.join(account, pattern), recursive=True) if os.path.isfile(p)}
    return sorted(p for p in found if wanted is None or folder_of(p).lower() in wanted)


def folder_of(path: str) -> str:
    name = os.path.basename(path)
    return os.path.basename(os.path.dirname(path)).removesuffix(".mbox") if name == "mbox" else name.removesuffix(".mbox")


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, stop: int, entries: list[tuple[int, int]] | None = None):
        self.path, self.start, self.stop, self.entries = path, start, stop, entries


def messages(part: Stretch) -> Iterator[bytes]:
    """The raw messages that begin within a stretch."""
    with open(part.path, "rb") as f:
        if part.entries is not None:
            for offset, length in part.entries:
                f.seek(offset)
                yield f.read(length)
            return
        at = max(0, part.start - 1)
        f.seek(at)
        if part.start:
            at += len(f.readline())  # to the first line that begins in the stretch
        f.seek(max(0, at - 3))
        before = f.read(min(3, at))
        f.seek(at)
        held: list[bytes] = []
        blank = at == 0 or before.endswith((b"\n\n", b"\n\r\n"))
        for line in f:
            if line.startswith(b"From ") and blank:
                if held:
                    yield b"".join(held)
                    held = []
                if at >= part.stop:
                    return
                held = [line]
            elif held:
                held.append(line)
            elif at >= part.stop:
                return
            blank = line in (b"\n", b"\r\n")
            at += len(line)
        if held:
            yield b"".join(held)


class MboxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted({p for x in options["path"].split(",") for p in glob.glob(x.removeprefix("file:").replace("//", "/"), recursive=True) if os.path.isfile(p)})
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        day = lambda k: datetime.fromisoformat(options[k]).replace(tzinfo=UTC) if options.get(k) else None
        self.since, self.until = day("since"), day("until")

    def partitions(self) -> list[Stretch]:
        out: list[Stretch] = []
        for p in self.paths:
            entries = read_index(p + ".imap")
            if entries is not None:
                with open(p, "rb") as f:  # only the stretch of the index that the bounds leave
                    stop = first_from(f, entries, self.until) if self.until else len(entries)
                    entries = entries[first_from(f, entries, self.since) if self.since else 0 : stop]
                out += [Stretch(p, 0, 0, entries[i : i + 10_000]) for i in range(0, len(entries), 10_000)]
            else:
                size = os.path.getsize(p)
                out += [Stretch(p, at, min(size, at + self.split)) for at in range(0, size, self.split)]
        return out or [Stretch(os.devnull, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        folder = folder_of(partition.path)
        bounded = self.since is not None or self.until is not None
        for data in messages(partition):
            row = parse(data, folder)
            at = row[8]
            if not bounded or at is not None and (self.since is None or at >= self.since) and (self.until is None or at < self.until):
                yield row


class MboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MboxReader:
        return MboxReader(self.options)
