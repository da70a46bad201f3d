"""Platforms, formats and options."""

from __future__ import annotations

import datetime as dt
import os
import re
from dataclasses import dataclass, replace
from enum import Enum

from chatloom.errors import InvalidDateError, InvalidFormatError

KB, MB = 1024, 1024 * 1024


class Platform(Enum):
    """Where an export comes from: name, short name, usual extension."""

    TELEGRAM = ("telegram", "tg", "json")
    WHATSAPP = ("whatsapp", "wa", "txt")
    INSTAGRAM = ("instagram", "ig", "json")
    DISCORD = ("discord", "dc", "json")

    @property
    def default_extension(self) -> str:
        return self.value[2]

    def __str__(self) -> str:
        return {"whatsapp": "WhatsApp"}.get(self.value[0], self.value[0].capitalize())

    @classmethod
    def all_names(cls) -> list[str]:
        return [n for p in cls for n in p.value[:2]]

    @classmethod
    def from_name(cls, name: str | Platform) -> Platform:
        if isinstance(name, cls):
            return name
        for p in cls:
            if name.lower() in p.value[:2]:
                return p
        raise InvalidFormatError("platform", f"unknown platform {name!r}, expected one of {', '.join(cls.all_names())}")


class OutputFormat(Enum):
    """Name, other names, extension, media type."""

    CSV = ("csv", (), "csv", "text/csv")
    JSON = ("json", (), "json", "application/json")
    JSONL = ("jsonl", ("ndjson",), "jsonl", "application/x-ndjson")

    @property
    def extension(self) -> str:
        return self.value[2]

    @property
    def mime_type(self) -> str:
        return self.value[3]

    def __str__(self) -> str:
        return self.value[0].upper()

    @classmethod
    def all_names(cls) -> list[str]:
        return [n for f in cls for n in (f.value[0], *f.value[1])]

    @classmethod
    def from_name(cls, name: str | OutputFormat) -> OutputFormat:
        if isinstance(name, cls):
            return name
        for f in cls:
            if name.lower() in (f.value[0], *f.value[1]):
                return f
        raise InvalidFormatError("output", f"unknown format {name!r}, expected one of {', '.join(cls.all_names())}")

    @classmethod
    def from_path(cls, path: str) -> OutputFormat:
        ext = os.path.splitext(path)[1].lstrip(".")
        if not ext:
            raise InvalidFormatError("output", f"{path!r} has no extension")
        return cls.from_name(ext)


@dataclass(frozen=True)
class OutputConfig:
    """Which fields are written beside sender and content."""

    timestamps: bool = False
    ids: bool = False
    replies: bool = False
    edited: bool = False

    @classmethod
    def all(cls) -> OutputConfig:
        return cls(True, True, True, True)

    def with_timestamps(self) -> OutputConfig:
        return replace(self, timestamps=True)

    def with_ids(self) -> OutputConfig:
        return replace(self, ids=True)

    def with_replies(self) -> OutputConfig:
        return replace(self, replies=True)

    def with_edited(self) -> OutputConfig:
        return replace(self, edited=True)

    def has_any(self) -> bool:
        return self.timestamps or self.ids or self.replies or self.edited


def parse_date(text: str) -> dt.datetime:
    """The start of a day written YYYY-MM-DD, in UTC."""
    if not re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", text):
        raise InvalidDateError(text)
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").replace(tzinfo=dt.timezone.utc)
    except ValueError:
        raise InvalidDateError(text) from None


@dataclass(frozen=True)
class FilterConfig:
    """Active conditions on messages; both dates are inclusive, the latter until its last full second."""

    after: dt.datetime | None = None
    before: dt.datetime | None = None
    sender: str | None = None

    def with_date_from(self, day: str) -> FilterConfig:
        return replace(self, after=parse_date(day))

    def with_date_to(self, day: str) -> FilterConfig:
        return replace(self, before=parse_date(day) + dt.timedelta(hours=23, minutes=59, seconds=59))

    def with_after(self, at: dt.datetime) -> FilterConfig:
        return replace(self, after=at)

    def with_before(self, at: dt.datetime) -> FilterConfig:
        return replace(self, before=at)

    def with_sender(self, name: str) -> FilterConfig:
        return replace(self, sender=name)

    after_date, before_date, with_user = with_date_from, with_date_to, with_sender

    def has_date_filter(self) -> bool:
        return self.after is not None or self.before is not None

    def has_user_filter(self) -> bool:
        return self.sender is not None

    def is_active(self) -> bool:
        return self.has_date_filter() or self.has_user_filter()


@dataclass(frozen=True)
class SourceConfig:
    """Options that all sources share. Buffers have no meaning here and are kept for callers that set them."""

    streaming: bool = False
    buffer_size: int = 64 * KB
    max_message_size: int = 10 * MB
    skip_invalid: bool = True

    @classmethod
    def for_streaming(cls):
        return cls(streaming=True, buffer_size=256 * KB)

    def with_(self, **options):
        """A copy with other options."""
        return replace(self, **options)


@dataclass(frozen=True)
class TelegramConfig(SourceConfig):
    pass


@dataclass(frozen=True)
class WhatsAppConfig(SourceConfig):
    skip_system_messages: bool = True
    disambiguate_slash: bool = False  # day-first bracketed dates where some first number exceeds 12


@dataclass(frozen=True)
class InstagramConfig(SourceConfig):
    fix_encoding: bool = True


@dataclass(frozen=True)
class DiscordConfig(SourceConfig):
    prefer_nickname: bool = True
    include_attachments: bool = True


CONFIGS = {Platform.TELEGRAM: TelegramConfig, Platform.WHATSAPP: WhatsAppConfig, Platform.INSTAGRAM: InstagramConfig, Platform.DISCORD: DiscordConfig}


@dataclass(frozen=True)
class StreamingConfig:
    buffer_size: int = 64 * KB
    max_message_size: int = 10 * MB
    skip_invalid: bool = True
    progress_interval: int = 10_000

    def with_(self, **options) -> StreamingConfig:
        return replace(self, **options)
