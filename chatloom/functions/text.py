"""Column functions on texts, identifiers and stamps of single records."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases of notices in WhatsApp exports. English ones are looked for in any letter case.
NOTICES_EN = [
    "Messages and calls are end-to-end encrypted", "created group", "added", "removed", "left", "changed the subject", "changed this group's icon",
    "changed the group description", "deleted this group's icon", "changed their phone number", "joined using this group's invite link",
    "security code changed", "You're now an admin", "is now an admin", "disappeared", "turned on disappearing messages", "turned off disappearing messages",
]
# The Russian ones, in their letter case.
NOTICES_RU = [
    "Сообщения и звонки защищены сквозным шифрованием", "создал(а) группу", "добавил", "удалил", "вышел", "покинул", "изменил тему", "изменил иконку группы",
    "изменил описание группы", "удалил иконку группы", "изменил номер телефона", "присоединился по ссылке", "код безопасности изменён", "теперь администратор",
    "включил исчезающие сообщения", "выключил исчезающие сообщения", "Подробнее",
]

U64_MAX = "18446744073709551615"
_TRIM = r"(?U)^\s+|\s+$"


def not_blank(text: Column) -> Column:
    """Has a character that is no Unicode white space."""
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def trim_all(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, _TRIM, "")


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_notice(sender: Column, content: Column) -> Column:
    """A system notice of WhatsApp by its phrases or its sender. Plain substrings: ``I left home`` is one, too."""
    who, what = F.lower(sender), F.lower(content)
    phrases = [what.contains(p.lower()) for p in NOTICES_EN] + [content.contains(p) for p in NOTICES_RU]
    return reduce(or_, phrases) | ~not_blank(sender) | who.contains("whatsapp") | who.contains("system")


def unix_seconds(text: Column) -> Column:
    """An instant from a string of whole seconds, else null."""
    n = F.when(text.rlike(r"^[+-]?[0-9]+\z"), text).try_cast("bigint")
    return F.when(n.between(-62_135_596_800, 253_402_300_799), F.timestamp_seconds(n))


def unix_millis(n: Column) -> Column:
    return F.when(n.between(-62_135_596_800_000, 253_402_300_799_999), F.timestamp_millis(n))


def rfc3339(text: Column) -> Column:
    """An instant from date, time and zone, all required; null without one of them."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})\z")
    return F.when(ok, F.upper(text)).try_cast("timestamp")


def u64(text: Column) -> Column:
    """An unsigned 64-bit number from digits with an optional plus sign, else null."""
    digits = F.regexp_replace(F.when(text.rlike(r"^\+?[0-9]+\z"), text), r"^\+?0*(?=[0-9])", "")
    n = F.when(F.length(digits) <= 20, digits).try_cast("decimal(20,0)")
    return F.when(n <= F.lit(U64_MAX).cast("decimal(20,0)"), n)


def low_byte_repair(text: Column) -> Column:
    """UTF-8 that was read as Latin-1: each code point's low byte, read as UTF-8; the text itself if that is invalid.

    Pure ASCII stays. Code points above 255 lose their upper bits: correct Cyrillic gets damaged, which is why this
    can be switched off.
    """
    code = lambda c: F.lpad(F.hex(F.ascii(c).bitwiseAND(F.lit(255))), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.split(text, ""), code), ""))
    return F.when(~text.rlike(r"[^\x00-\x7F]"), text).otherwise(F.coalesce(F.try_validate_utf8(data.cast("string")), text))


def last_segment(url: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(url, "/"), -1)


def variant_text(v: Column) -> Column:
    """The text of an untyped JSON value: a string; of an array, its strings and the string ``text`` of its objects.

    Other values, and what an array holds besides, give nothing: an empty text.
    """
    kind = F.schema_of_variant(v)

    def part(e: Column) -> Column:
        inner = F.try_variant_get(e, "$.text", "variant")
        return (
            F.when(F.schema_of_variant(e) == "STRING", F.variant_get(e, "$", "string"))
            .when(F.schema_of_variant(e).startswith("OBJECT") & (F.schema_of_variant(inner) == "STRING"), F.variant_get(inner, "$", "string"))
        )

    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), part)
    return F.when(kind == "STRING", F.variant_get(v, "$", "string")).when(kind.startswith("ARRAY"), F.array_join(parts, "")).otherwise(F.lit(""))


def append_lines(content: Column, *lines: Column) -> Column:
    """Content and the items of arrays, one per line; an empty content (not a blank one) has no line."""
    none = F.array().cast("array<string>")
    head = F.filter(F.array(content), lambda c: c != "")
    return F.array_join(F.concat(head, *[F.coalesce(x, none) for x in lines]), "\n")


def attachment_lines(names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit("[Attachment: "), n, F.lit("]")))


def sticker_lines(names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit("[Sticker: "), n, F.lit("]")))


def url_names(urls: Column) -> Column:
    """The names of comma-separated addresses."""
    parts = F.transform(F.split(urls, ","), trim_all)
    return F.transform(F.filter(parts, lambda u: u != ""), last_segment)


def split_lines(text: Column) -> Column:
    """The lines of a text: separated by LF, without a CR before it; no empty line at the end."""
    lines = F.split(text, "\r?\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def local_stamp(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column, half: Column | None = None, short_year: Column | None = None) -> Column:
    """A UTC instant from numbers; two-digit years 70-99 are 19xx; with AM/PM hours are 1 to 12; else null."""
    if short_year is not None:
        y = F.when(short_year, y + F.when(y >= 70, 1900).otherwise(2000)).otherwise(y)
    if half is not None:
        h = F.when(half == "", h).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    return F.try_make_timestamp(y, m, d, h, mi, s.cast("decimal(16,6)"))


def stamp_text(ts: Column, style: str = "csv") -> Column:
    """An instant as text, fractions cut."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss" if style == "csv" else "yyyy-MM-dd'T'HH:mm:ss'Z'")
