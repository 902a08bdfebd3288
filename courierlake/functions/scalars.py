"""Scalar functions over message fields, as native columns."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def content_hash(raw: Column) -> Column:
    """The address of a message or blob: 64 hexadecimal digits (SHA-256)."""
    return F.sha2(raw, 256)


def attachment_hash(raw: Column) -> Column:
    """The address of a raw attachment, in a domain of its own."""
    return F.sha2(F.concat(F.lit("raw-mime-attachment.v1").cast("binary"), raw.cast("binary")), 256)


def short_hash(x: Column) -> Column:
    """32 hexadecimal digits for grouping."""
    return F.md5(x.cast("binary"))


def id_hash(*x: Column) -> Column:
    """A 53-bit id, which floating-point consumers hold without loss."""
    return F.xxhash64(*x).bitwiseAND(F.lit((1 << 53) - 1))


def thread_id(in_reply_to: Column, references: Column, message_id: Column) -> Column:
    """The thread of the first reference if a message has both a parent and references, else a thread of its own."""
    return short_hash(F.when(in_reply_to.isNotNull() & (F.coalesce(F.size(references), F.lit(0)) > 0), F.try_element_at(references, F.lit(1))).otherwise(message_id))


def message_date(date: Column, internal: Column, received: Column) -> Column:
    """The date header if positive, else the internal date if positive, else the newest receipt, else 0 (unknown)."""
    positive = lambda x: F.when(x > 0, x)
    return F.coalesce(positive(date), positive(internal), F.array_max(received), F.lit(0)).cast("long")


def effective_date(date: Column, internal: Column) -> Column:
    """The earlier of the known dates; zero is unknown, and null if neither is known."""
    return F.least(F.nullif(date, F.lit(0)), F.nullif(internal, F.lit(0)))


def preview(body: Column, chars: int = 100) -> Column:
    return F.when(F.length(body) > chars, F.concat(F.substring(body, 1, chars), F.lit("..."))).otherwise(body)


def collapse_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


#: Patterns of attributes and rules that load remote content, with what stays of them.
REMOTE = (
    (r"""(?i)\s+(src|poster|data)\s*=\s*["'][^"']*(?:https?://|//)[^"']*["']""", ""),
    (r"""(?i)\s+srcset\s*=\s*["'][^"']*(?:https?://|//)[^"']*["']""", ""),
    (r"""(?i)(<link\b[^>]*)\s+href\s*=\s*["'][^"']*(?:https?://|//)[^"']*["']""", "$1"),
    (r"""(?i)url\(\s*["']?\s*(?:https?://|//)[^)"'\s]*\s*["']?\s*\)""", ""),
    (r"""(?i)@import\s+url\(\s*["']?\s*(?:https?://|//)[^)"'\s]*\s*["']?\s*\)\s*;""", ""),
    (r"""(?i)(<body\b[^>]*)\s+background\s*=\s*["'][^"']*(?:https?://|//)[^"']*["']""", "$1"),
)


def block_remote_content(html: Column) -> Column:
    for pattern, stays in REMOTE:
        html = F.regexp_replace(html, pattern, stays)
    return html


def html_text(html: Column) -> Column:
    """The readable text of a page without a parser: no scripts, styles, comments or tags; named and numbered entities
    decoded, each once; white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"), F.lit(0)))
    named = F.create_map(*(F.lit(v) for name, code in name2codepoint.items() if name != "amp" for v in (f"&{name};", chr(code))))

    def char(e: Column) -> Column:
        code = F.when(e.rlike("^&#[xX]"), F.conv(F.substring(e, 4, 6), 16, 10)).when(e.startswith("&#"), F.regexp_extract(e, "[0-9]+", 0)).cast("long")
        fine = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.coalesce(F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.try_element_at(named, e), e)

    x = F.aggregate(found, x, lambda text, e: F.replace(text, e, char(e)))
    return collapse_space(F.translate(F.replace(x, F.lit("&amp;"), F.lit("&")), "\u00a0", " "))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; null without one, and for names whose only dot comes first."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    ext = F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))
    return F.when(base.rlike(r"^.+\.[^.]*$") & (base != ".."), ext)


#: Groups of file extensions.
CATEGORIES = {
    "document": "doc docx pdf rtf odt pages pptx ppt",
    "spreadsheet": "xls xlsx ods numbers csv",
    "event": "ical ics vcs ifb icalendar",
    "text": "txt log md",
    "image": "jpg jpeg png gif bmp tiff avif heic heif webp",
    "video": "mp4 mkv mov avi webm",
    "audio": "wav mp3 aac ogg wma flac aiff",
    "graphics_2d": "psd eps svg cdr ai",
    "graphics_3d": "stl obj 3mf amf f3d sldprt stp step dwg x_t x_b sat ipt",
    "code": "c h html css js ts vue tsx svelte py java cs go rb php swift rs r jl lua sql",
    "data": "tsv xml json yml yaml toml env ini",
    "executable": "ps1 sh bat cmd exe msi dmg pkg deb rpm",
    "archive": "zip gz tgz 7z rar tar bz2 zst xz iso img",
    "message": "eml msg",
}
#: What a media type says where the extension is unknown, the first rule that holds.
TYPES = (
    ("^image/", "image"), ("^video/", "video"), ("^audio/", "audio"), ("^text/", "text"), ("^message/rfc822$", "message"),
    ("compressed|zip|archive", "archive"), ("pdf|msword|officedocument", "document"), ("spreadsheet|excel", "spreadsheet"),
)


def category(name: Column, content_type: Column) -> Column:
    ext, mime = extension(name), F.lower(content_type)
    out = F.lit(None).cast("string")
    for group, exts in CATEGORIES.items():
        out = F.when(ext.isin(exts.split()), group).otherwise(out)
    other = F.lit("other")
    for pattern, group in reversed(TYPES):
        other = F.when(mime.rlike(pattern), group).otherwise(other)
    return F.coalesce(out, other)


#: Bounds in bytes of the size classes of a message list, both inclusive.
SIZES = {
    "tiny": (None, 15 * 1024),
    "small": (None, 2 * 1024 * 1024),
    "medium": (2 * 1024 * 1024, 10 * 1024 * 1024),
    "large": (10 * 1024 * 1024, 20 * 1024 * 1024),
    "huge": (20 * 1024 * 1024, None),
}


def in_size_preset(size: Column, preset: str) -> Column:
    """Whether a size is in a class; the smallest two have no lower bound. ``any`` takes all."""
    low, high = SIZES.get(preset, (None, None))
    out = F.lit(True)
    if low is not None:
        out = out & (size >= low)
    if high is not None:
        out = out & (size <= high)
    return out


def below_watermark(remote: Column, before: Column, new_uids: Column) -> Column:
    """Whether a mailbox grew by more than the messages above the watermark tell."""
    return F.greatest(remote - before, F.lit(0)) > new_uids


def valid_facet(tag: Column) -> Column:
    return tag.startswith("/")


def fixed_or_relative(fixed: Column, today: Column, unit: Column, value: Column) -> Column:
    """A fixed date, or one that lies ``value`` days, months or years before ``today``. Years before 1970 are null."""
    back = F.when(unit == "Days", F.date_sub(today, value))
    back = back.when(unit == "Months", F.add_months(today, -value)).when(unit == "Years", F.add_months(today, -12 * value))
    out = F.coalesce(fixed, back)
    return F.when(F.year(out) >= 1970, out)


#: Labels that tell the state of a message.
STATUS_LABELS = (
    "Opened", "Unread", "Archived", "Ouverts", "Non lus", "Archivés", "Abiertos", "No leídos", "Archivados", "Aperti", "Non letti", "Archiviati",
    "Abertos", "Não lidos", "Arquivados", "Geöffnet", "Ungelesen", "Archiviert", "Geopend", "Ongelezen", "Gearchiveerd", "Öppnade", "Olästa", "Arkiverade",
    "Åbnet", "Ulæst", "Arkiveret", "Åpnet", "Ulest", "Arkivert", "Avatut", "Lukemattomat", "Arkistoidut", "Otworzone", "Nieprzeczytane", "Zarchiwizowane",
    "Otevřené", "Nepřečtené", "Archivováno", "Megnyitott", "Olvasatlan", "Archivált", "Deschise", "Necitite", "Arhivate", "Открытые", "Непрочитанные", "В архиве",
    "Відкриті", "Непрочитані", "В архіві", "Açıldı", "Okunmamış", "Arşivlendi", "Ανοιγμένα", "Μη αναγνωσμένα", "Αρχειοθέτηση",
)
#: Labels of general folders.
GENERIC_LABELS = (
    "Inbox", "Sent", "Boîte de réception", "Envoyé", "Recibidos", "Enviados", "Posta in arrivo", "Inviati", "Caixa de entrada", "Enviados", "Posteingang", "Gesendet",
    "Postvak IN", "Verzonden items", "Inkorgen", "Skickade", "Indbakke", "Sendt", "Innboks", "Sendt", "Saapuneet", "Lähetetyt", "Odebrane", "Wysłane",
    "Doručená pošta", "Odeslané", "Beérkezett üzenetek", "Elküldött üzenetek", "Căsuța de intrare", "Trimise", "Входящие", "Отправленные",
    "Вхідні", "Надіслані", "Gelen Kutusu", "Gönderilmiş", "Εισερχόμενα", "Απεσταλμένα",
)


def folder_of_labels(labels: Column) -> Column:
    """The folder of a comma-separated list of labels: without status labels, the first that isn't a general
    folder, else the first; the first of all if nothing else is left, and ``Unknown`` for an empty list."""
    every = F.filter(F.transform(F.split(F.coalesce(labels, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rest = F.filter(every, lambda x: ~x.isin(*STATUS_LABELS))
    own = F.filter(rest, lambda x: ~x.isin(*dict.fromkeys(GENERIC_LABELS)))
    first = lambda a: F.try_element_at(a, F.lit(1))
    return F.coalesce(F.when(F.size(rest) > 1, first(own)), first(rest), first(every), F.lit("Unknown"))


def meta_header(value: Column, schema: str) -> Column:
    """A base64 JSON header; null if it is damaged."""
    return F.from_json(F.try_to_binary(value, F.lit("base64")).cast("string"), schema)
