"""Texts of source files in any charset."""

from __future__ import annotations

import codecs

# Names of charsets.
CHARSETS = {"utf-8": "utf-8", "utf8": "utf-8", "gbk": "gb18030", "gb2312": "gb18030", "gb18030": "gb18030", "shift-jis": "cp932", "shift_jis": "cp932", "latin1": "cp1252", "big5": "big5hkscs", "euc-kr": "cp949"}
#: Bytes that Windows-1252 leaves open read as the control characters of the same number.
codecs.register_error("windows-1252", lambda e: (e.object[e.start : e.end].decode("latin1"), e.end))


def decode_source(raw: bytes, encoding: str = "auto") -> str:
    """Text of a source; never fails. `auto`: a UTF-8 mark, valid UTF-8, GBK, Shift-JIS, else Windows-1252."""
    if encoding.lower() != "auto":
        name = CHARSETS.get(encoding.lower(), encoding)
        try:
            return raw.removeprefix(b"\xef\xbb\xbf" if name == "utf-8" else b"").decode(name, "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", "replace")
    for name in ("utf-8", "gb18030", "cp932"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("cp1252", "windows-1252")


def effective_encoding(option: str = "auto", configured: str | None = None) -> str:
    """The command line's encoding unless it is auto, then the configuration's."""
    return option if option != "auto" else configured or "auto"
