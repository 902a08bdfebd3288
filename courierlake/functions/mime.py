"""MIME messages: subjects, parts, detached attachments and the text of office files, as Arrow functions."""

from __future__ import annotations

import email
import email.policy
import hashlib
import io
import re
import zipfile
from email.header import decode_header
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of office files that hold their text, by extension.
OFFICE = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "odt": r"content\.xml", "odp": r"content\.xml", "ods": r"content\.xml", "xlsx": r"xl/sharedStrings\.xml"}
CANDIDATES = ("utf-8", "cp1252")


def decoded_header(raw: str | None) -> str | None:
    """A header with its encoded words decoded, those of one charset that follow each other joined before; what
    can't be decoded stays."""
    if raw is None:
        return None
    try:
        parts = decode_header(re.sub(r"\?=\s+=\?", "?==?", raw))
    except (ValueError, email.errors.HeaderParseError):
        return raw
    merged: list[tuple[bytes | str, str | None]] = []
    for data, charset in parts:
        if merged and charset and merged[-1][1] == charset and isinstance(data, bytes):
            merged[-1] = (merged[-1][0] + data, charset)
        else:
            merged.append((data, charset))
    return "".join(d if isinstance(d, str) else repaired(d, c) for d, c in merged)


def repaired(data: bytes, charset: str | None = None) -> str:
    """Bytes by their declared charset, else by the first candidate that fits."""
    for c in (charset, *CANDIDATES):
        try:
            if c:
                return data.decode(c)
        except (LookupError, UnicodeDecodeError):
            pass
    return data.decode("latin-1")


def _header(x: pd.Series) -> pd.Series:
    return x.map(decoded_header, na_action="ignore")


def header_text(x: Column) -> Column:
    return F.pandas_udf(_header, "string")(x)


MESSAGE = (
    "struct<message_id:string,subject:string,sender:string,to:array<string>,cc:array<string>,bcc:array<string>,date_ms:bigint,in_reply_to:string,references:array<string>,"
    "body:string,html:string,attachments:array<struct<filename:string,file_type:string,size:bigint,content_hash:string,inline:boolean,content_id:string>>,error:string>"
)


def parsed(raw: bytes) -> dict:
    """The fields of a message. Damage is told in ``error``; fields that could be read are there all the same."""
    from email.utils import getaddresses, parsedate_to_datetime

    out: dict = {k: None for k in ("message_id", "subject", "sender", "date_ms", "in_reply_to", "body", "html", "error")} | {k: [] for k in ("to", "cc", "bcc", "references", "attachments")}
    try:
        m = email.message_from_bytes(raw, policy=email.policy.compat32)
        text = lambda name: decoded_header(str(m[name])) if m[name] is not None else None
        out |= {"message_id": (text("Message-ID") or "").strip(" <>\r\n") or None, "subject": text("Subject"), "in_reply_to": (text("In-Reply-To") or "").strip(" <>\r\n") or None}
        out["references"] = re.findall(r"<([^<>\s]+)>", str(m["References"] or ""))
        for k in ("to", "cc", "bcc"):
            out[k] = [a.lower() for _, a in getaddresses([str(x) for x in m.get_all(k, [])]) if a]
        out["sender"] = next((a.lower() for _, a in getaddresses([str(m["From"] or "")]) if a), "unknown")
        try:
            out["date_ms"] = int(parsedate_to_datetime(str(m["Date"])).timestamp() * 1000)
        except (TypeError, ValueError):
            pass
        for part in m.walk():
            if part.is_multipart() and part.get_content_type() != "message/rfc822":
                continue
            kind, name = part.get_content_type(), part.get_filename()
            data = part.get_payload(decode=True)
            if data is None:
                data = part.get_payload(0).as_bytes() if kind == "message/rfc822" and part.is_multipart() else b""
            slot = {"text/plain": "body", "text/html": "html"}.get(kind)
            if slot and out[slot] is None and not name and part.get_content_disposition() != "attachment":
                out[slot] = repaired(data, part.get_content_charset())
            else:
                cid = part.get("Content-ID")
                out["attachments"].append({"filename": decoded_header(name), "file_type": kind, "size": len(data), "content_hash": hashlib.sha256(data).hexdigest(), "inline": part.get_content_disposition() == "inline" and cid is not None, "content_id": cid and cid.strip("<> ")})
    except Exception as e:  # one damaged message must not end a whole import
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def _parse(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsed(r or b"") for r in x], columns=list(parsed(b"")))


def parse_message(raw: Column) -> Column:
    """A raw message as a struct."""
    return F.pandas_udf(_parse, MESSAGE)(raw)


def office_text(ext: str | None, data: bytes | None) -> str | None:
    """The text of an office file, or of plain text; null for other types and damaged files."""
    try:
        if (ext or "") in ("txt", "md", "csv", "log", "json", "xml"):
            return repaired(data)
        pattern = OFFICE.get(ext or "")
        if not pattern or data is None:
            return None
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: [int(d) for d in re.findall(r"\d+", n)])
            found = [" ".join(t for t in ElementTree.fromstring(z.read(n)).itertext() if t.strip()) for n in names]
        return "\n".join(found) or None
    except Exception:  # a damaged file has no text
        return None


def _office(ext: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([office_text(e, d) for e, d in zip(ext, data)])


#: Functions from extension and bytes to text by name; others may be added.
EXTRACTORS = {"default": _office}


def extract_text(ext: Column, data: Column, extractor: str = "default") -> Column:
    return F.pandas_udf(EXTRACTORS[extractor], "string")(ext, data)


def placeholder(content_hash: str) -> bytes:
    return f"[detached:{content_hash}]".encode()


def strip_parts(raw: bytes, spans: list[tuple[int, int, str]]) -> bytes:
    """A message whose byte ranges ``(start, end, hash)`` are replaced by placeholders, the last one first."""
    for start, end, h in sorted(spans, reverse=True):
        raw = raw[:start] + placeholder(h) + raw[end:]
    return raw


def reattach(raw: bytes, bodies: dict[str, bytes]) -> bytes:
    """The inverse of ``strip_parts``; placeholders without a body stay."""
    return re.sub(rb"\[detached:([0-9a-f]{64})\]", lambda m: bodies.get(m[1].decode(), m[0]), raw)


DETACHED = "struct<raw:binary,parts:array<struct<content_hash:string,body:binary>>>"


def attachment_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """Where the bodies of a message's attachments stand, as they are encoded there, and their SHA-256. Text parts
    without a name and empty bodies aren't attachments; neither are parts that can't be found again as they stand."""
    spans, at = [], 0
    for part in email.message_from_bytes(raw, policy=email.policy.compat32).walk():
        held = part.get_payload()
        if not isinstance(held, str) or not held:
            continue
        body = held.encode() if held.isascii() else part.get_payload(decode=True)  # 8-bit bodies come whole as bytes alone
        start = raw.find(body, at)
        if start < 0:
            continue
        at = start + len(body)
        own_text = part.get_content_maintype() == "text" and not part.get_filename() and part.get_content_disposition() != "attachment"
        if not own_text and not re.fullmatch(rb"\[detached:[0-9a-f]{64}\]", body):
            spans.append((start, at, hashlib.sha256(body).hexdigest()))
    return spans


def detached_parts(raw: bytes) -> dict:
    """A message with placeholders for its attachments, and their bodies by hash, each once."""
    try:
        spans = attachment_spans(raw)
    except Exception:  # a damaged message stays as it is
        spans = []
    bodies = {h: raw[a:b] for a, b, h in spans}
    return {"raw": strip_parts(raw, spans), "parts": [{"content_hash": h, "body": b} for h, b in bodies.items()]}


def _detach(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detached_parts(bytes(r or b"")) for r in x], columns=["raw", "parts"])


def detached(raw: Column) -> Column:
    """A raw message as a struct of the message with placeholders and the parts that went."""
    return F.pandas_udf(_detach, DETACHED)(raw)


def _reattach(raw: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([reattach(bytes(r), {p["content_hash"]: bytes(p["body"]) for p in ps}) for r, ps in zip(raw, parts)])


def reattached(raw: Column, parts: Column) -> Column:
    """The inverse of ``detached``; placeholders without a part stay."""
    return F.pandas_udf(_reattach, "binary")(F.coalesce(raw, F.lit(b"")), F.coalesce(parts, F.array().cast("array<struct<content_hash:string,body:binary>>")))
