"""URL functions. Column expressions where they can say it; a vectorised function for resolving and normalising."""

from __future__ import annotations

import mimetypes
import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of query parameters that only track visits.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid gclid gclsrc dclid msclkid twclid ref ref_src source "
    "mc_cid mc_eid si spm _ga _gl _hsenc _hsmi hsa_cam hsa_grp hsa_mt hsa_src hsa_ad hsa_acc hsa_net hsa_ver hsa_kw hsa_tgt hsa_la hsa_ol"
).split()
# File extensions by purpose.
DOWNLOADS = (
    ".pdf .doc .docx .xls .xlsx .ppt .pptx .odt .ods .odp .rtf .tex .txt .csv .zip .rar .7z .tar .gz .bz2 .xz "
    ".mp3 .mp4 .avi .mov .wmv .flv .mkv .wav .flac .aac .ogg .webm .svg .eps .tiff .raw .psd .ai "
    ".json .xml .yaml .yml .sql .db .exe .msi .dmg .apk .deb .rpm"
).split()
IMAGES = ".jpg .jpeg .png .gif .webp .svg .bmp .ico .tiff .avif".split()
VIDEOS = ".mp4 .webm .avi .mov .wmv .flv .mkv .m4v .ogv".split()
PAGES = ".html .htm .php .asp .aspx .jsp".split()
TYPES = {
    ".pdf": "PDF Document", ".doc": "Word Document", ".docx": "Word Document", ".xls": "Excel Spreadsheet", ".xlsx": "Excel Spreadsheet", ".ppt": "PowerPoint Presentation",
    ".pptx": "PowerPoint Presentation", ".zip": "ZIP Archive", ".rar": "RAR Archive", ".csv": "CSV File", ".json": "JSON File", ".xml": "XML File",
}
#: Public suffixes of two labels that are known besides the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.in", "com.br", "com.cn", "com.mx", "co.za", "com.tr", "co.kr", "com.sg", "com.hk")

_ABSOLUTE = re.compile(r"https?://")


def _clean_path(path: str) -> str:
    stack: list[str] = []
    for name in re.split("/+", path):
        if name == ".." and stack and stack[-1]:
            stack.pop()
        elif name != ".":
            stack.append(name)
    joined = "/".join(stack)
    joined = joined if joined.startswith("/") else "/" + joined
    return quote(joined.rstrip("/") or "/", safe="/:@!$&'()*+,;=-._~")


def _clean_query(query: str) -> str:
    kept = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in TRACKING]
    return urlencode(sorted(kept))


def normalized(url: str | None, base: str | None = None) -> str | None:
    """The canonical form of an http(s) URL, resolved against a base; None where there's none.

    The whole URL is percent-decoded first, so encoded delimiters delimit; the path's case stays.
    """
    if url is None:
        return None
    try:
        full = urljoin(base, url) if base and not _ABSOLUTE.match(url) else url
        u = urlsplit(unquote(full))
        if u.scheme.lower() not in ("http", "https") or not u.hostname:
            return None
        scheme, host, port = u.scheme.lower(), u.hostname.lower().strip("."), u.port
        if port and port != {"http": 80, "https": 443}[scheme]:
            host = f"{host}:{port}"
        if u.username:
            host = f"{u.username}{':' + u.password if u.password else ''}@{host}"
        path, params = u.path or "/", ""
        last = path.rfind("/")
        if (cut := path.find(";", max(last, 0))) >= 0:
            path, params = path[:cut], path[cut:]
        params = "" if params == ";" else params
        query = _clean_query(u.query)
        return f"{scheme}://{host}{_clean_path(path)}{params}{'?' + query if query else ''}"
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def normalize(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalized(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def make_absolute(url: pd.Series, base: pd.Series) -> pd.Series:
    def one(u: str | None, b: str | None) -> str | None:
        try:
            return u if u is None or _ABSOLUTE.match(u) else urljoin(b or "", u)
        except ValueError:
            return None

    return pd.Series([one(u, b) for u, b in zip(url, base, strict=True)], dtype=object)


def netloc(url: Column) -> Column:
    """What stands between // and the path, with port and user."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def subdomain(url: Column) -> Column:
    """The whole host name, lower-cased, without user and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(netloc(url)), "^.*@", ""), r":\d*$", "")


def domain(url: Column) -> Column:
    """The registered domain: the public suffix and one label."""
    labels = F.split(subdomain(url), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*SUFFIXES), three).otherwise(two)


def same_domain(a: Column, b: Column) -> Column:
    return domain(a) == domain(b)


def same_subdomain(a: Column, b: Column) -> Column:
    return subdomain(a) == subdomain(b)


def is_internal(url: Column, base: Column, include_subdomains: bool = True) -> Column:
    return same_domain(url, base) if include_subdomains else same_subdomain(url, base)


def url_hash(url: Column) -> Column:
    return F.md5(F.regexp_replace(F.lower(url), r"^\s+|\s+$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def extension(url: Column) -> Column:
    """The lower-cased suffix of the path's last name, with its dot; "" without one."""
    bare = F.regexp_replace(path(F.coalesce(F.try_url_decode(url), url)), "/+$", "")
    return F.lower(F.regexp_extract(bare, r"[^/.][^/]*(\.[^./]+)$", 1))


def is_downloadable(url: Column) -> Column:
    return extension(url).isin(*DOWNLOADS)


def is_image(url: Column) -> Column:
    return extension(url).isin(*IMAGES)


def is_video(url: Column) -> Column:
    return extension(url).isin(*VIDEOS)


def is_webpage(url: Column) -> Column:
    return extension(url).isin("", *PAGES)


def file_type(url: Column) -> Column:
    ext = extension(url)
    names = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(names[ext], F.when(ext == "", F.lit("Unknown")).otherwise(F.upper(F.ltrim(ext, F.lit(".")))))


def mime_type(url: Column) -> Column:
    known = {k: v for k, v in mimetypes.types_map.items() if k in {*DOWNLOADS, *IMAGES, *VIDEOS, *PAGES}}
    return F.coalesce(F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[extension(url)], F.lit("application/octet-stream"))


def similarity(a: Column, b: Column) -> Column:
    """Share of path names that agree by place, for equal hosts; 1 for equal URLs, 0 for empty ones."""
    x, y = F.split(F.regexp_replace(path(a), "^/+|/+$", ""), "/"), F.split(F.regexp_replace(path(b), "^/+|/+$", ""), "/")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), lambda e: e))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(netloc(a) != netloc(b), 0.0).otherwise(same / F.greatest(F.size(x), F.size(y)))
