"""The few per-value helpers Spark has no expression for, run as Arrow batches.

Each takes NULL for the rows that do not need it, so ordinary rows cost a null bit.
"""

from __future__ import annotations

import ipaddress
import json
import re
import unicodedata
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

STRING = StringType()
STRINGS = ArrayType(STRING)

_FORBIDDEN = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def _octets(host: str) -> str | None:
    """The dotted quad for any of the IPv4 spellings browsers accept; None when out of range."""
    labels = host.rstrip(".").split(".") if host.endswith(".") else host.split(".")
    if len(labels) > 4:
        return None
    numbers = []
    for label in labels:
        try:
            if label.startswith("0x"):
                numbers.append(int(label[2:] or "0", 16))
            elif len(label) > 1 and label.startswith("0"):
                numbers.append(int(label, 8))
            else:
                numbers.append(int(label))
        except ValueError:
            return None
    if any(number > 255 for number in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return None
    value = numbers[-1] + sum(number << (8 * (3 - index)) for index, number in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


def canonical_host(raw: str) -> str | None:
    """A host name the way browsers write it, or None when it is not a valid host."""
    if raw.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(raw[1:-1]).compressed}]" if raw.endswith("]") else None
        except ValueError:
            return None
    try:
        name = unquote_to_bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    name = re.sub("[。．｡]", ".", unicodedata.normalize("NFKC", name.lower()).replace("­", ""))
    try:
        host = ".".join(
            label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii") for label in name.split(".")
        )
    except UnicodeError:
        return None
    if not host or _FORBIDDEN.search(host):
        return None
    last = (host[:-1] if host.endswith(".") else host).rsplit(".", 1)[-1]
    if re.fullmatch(r"[0-9]+|0x[0-9a-f]*", last):
        return _octets(host)
    return host


_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_SERVER = re.compile(r"(\[[^\]]*\]|[^:\[\]]+)(?::([0-9]*))?")
_ORDINARY_HOST = re.compile(r"(?:[0-9a-z._\-]*\.)?[a-z_\-][0-9a-z_\-]*")
_BASE = re.compile(r"(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?")
_DOTS = {".": 1, "%2e": 1, "..": 2, ".%2e": 2, "%2e.": 2, "%2e%2e": 2}
_IN_PATH = "!$%&'()*+,-./:;=@[\\]_|~"
_IN_QUERY = "!$%&()*+,-./:;=?@[\\]^_`{|}~"
_DEFAULT_PORT = {"http": 80, "https": 443}


def _authority(scheme: str, text: str) -> str | None:
    user, at, server = text.rpartition("@")
    found = _SERVER.fullmatch(server)
    if not found:
        return None
    host = found[1].lower()
    host = host if _ORDINARY_HOST.fullmatch(host) else canonical_host(host)
    port = int(found[2]) if found[2] else None
    if host is None or (port or 0) > 65535:
        return None
    shown = "" if port is None or port == _DEFAULT_PORT[scheme] else f":{port}"
    return (user + "@" if at and user not in ("", ":") else "") + host + shown


def _folded(path: str) -> str:
    kept: list[str] = []
    parts = path[1:].split("/")
    for part in parts:
        dots = _DOTS.get(part.lower(), 0)
        if dots == 2 and kept:
            kept.pop()
        elif not dots:
            kept.append(part)
    if parts[-1].lower() in _DOTS:
        kept.append("")
    return "/" + "/".join(kept)


def resolve_reference(reference: str, base: str | None) -> str | None:
    """A reference as an absolute http(s) URL without fragment, by the rules browsers use; None if it is not one."""
    text = re.sub(r"[\t\n\r]", "", reference.strip("".join(map(chr, range(33)))))
    origin = _BASE.fullmatch(base) if base else None
    named = _SCHEME.match(text)
    scheme = named[1].lower() if named else origin and origin[1]
    if scheme not in _DEFAULT_PORT:
        return None
    rest = (text[named.end():] if named else text).split("#", 1)[0]
    rest, mark, query = rest.partition("?")
    query = mark + query
    rest = rest.replace("\\", "/")
    if rest.startswith("//") or origin is None or scheme != origin[1]:
        server, slash, path = rest.lstrip("/").partition("/")
        authority, path = _authority(scheme, server), "/" + path
        if authority is None:
            return None
    else:
        authority, path = origin[2], rest
        if not path:
            path, query = origin[3] or "/", query or origin[4] or ""
        elif not path.startswith("/"):
            path = origin[3].rpartition("/")[0] + "/" + path
    path = quote(path, safe=_IN_PATH)
    if "/." in path or "/%2" in path:
        path = _folded(path)
    return f"{scheme}://{authority}{path}{quote(query, safe=_IN_QUERY)}"


@F.pandas_udf(STRINGS)
def _resolved(references: pd.Series, base: pd.Series) -> pd.Series:
    rows = zip(references, base)
    return pd.Series(
        [None if items is None else [None if i is None else resolve_reference(i, page) for i in items] for items, page in rows],
        dtype=object,
    )


# Marked so that the optimizer neither repeats it in pushed-down filters nor copies it into later projections.
resolve_references = _resolved.asNondeterministic()


# Labels of the web for text encodings other than UTF-8, UTF-16 and windows-1252, by the codec that reads
# them. The web reads several of them as the larger set that Windows uses.
CHARSETS = {
    "gb18030": ["gb2312", "gbk", "gb18030", "chinese", "csgb2312", "gb_2312-80", "x-gbk"],
    "cp932": ["shift_jis", "shift-jis", "sjis", "x-sjis", "ms_kanji", "csshiftjis", "windows-31j"],
    "cp949": ["euc-kr", "korean", "ks_c_5601-1987", "ksc5601", "windows-949"],
    "cp1254": ["iso-8859-9", "iso8859-9", "latin5", "l5", "windows-1254", "x-cp1254"],
    "cp874": ["iso-8859-11", "tis-620", "windows-874", "dos-874"],
    "big5hkscs": ["big5", "big5-hkscs", "cn-big5", "x-x-big5"],
    "euc_jp": ["euc-jp", "x-euc-jp"],
    "iso2022_jp": ["iso-2022-jp", "csiso2022jp"],
    "koi8_r": ["koi8-r", "koi", "koi8", "koi8_r"],
    "koi8_u": ["koi8-u", "koi8-ru"],
    "cp866": ["ibm866", "cp866", "866"],
    "mac_roman": ["macintosh", "mac", "x-mac-roman"],
    **{f"cp{n}": [f"windows-{n}", f"cp{n}", f"x-cp{n}"] for n in (1250, 1251, 1253, 1255, 1256, 1257, 1258)},
    **{f"iso8859_{n}": [f"iso-8859-{n}", f"iso8859-{n}", f"iso_8859-{n}"] for n in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)},
}
_CODECS = {label: codec for codec, labels in CHARSETS.items() for label in labels}


@F.pandas_udf(STRING)
def decode_charset(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes in one of the rarer encodings as text; unknown names are read as UTF-8."""

    def text(raw, name):
        if raw is None or name is None:
            return None
        return bytes(raw).decode(_CODECS.get(name, "utf-8"), errors="replace")

    return pd.Series([text(raw, name) for raw, name in zip(body, charset)], dtype=object)


def _types(document: str) -> list[str]:
    def reject(_):
        raise ValueError

    pending, found = [json.loads(document, parse_constant=reject)], []
    while pending:
        node = pending.pop()
        if isinstance(node, list):
            pending.extend(reversed(node))
        elif isinstance(node, dict):
            named = node.get("@type")
            found.extend(value for value in (named if isinstance(named, list) else [named]) if isinstance(value, str))
            pending.extend(node[key] for key in ("mainEntity", "@graph") if node.get(key))
    return found


@F.pandas_udf(STRINGS)
def jsonld_types(documents: pd.Series) -> pd.Series:
    """Distinct type names of a page's structured-data scripts, first seen first."""

    def per_page(texts):
        if texts is None:
            return None
        seen: dict[str, None] = {}
        for text in texts:
            try:
                seen.update(dict.fromkeys(_types(text)))
            except (ValueError, RecursionError):
                continue
        return list(seen)

    return documents.map(per_page)
