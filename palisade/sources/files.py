"""Files as rows (Spark's binaryFile: path, length, content): text extraction, structural checks, archives, active content."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions, lures before them, triggers in names, marks in PDF files, container types and their limits.
SUSPICIOUS = ".exe .bat .sh .scr .php .js .bin .dll .vbs .docm .xlsm .pptm .svg .svgz .jar .hta .wsf .ps1 .lnk .iso .jse .vbe .cmd .com .msi .reg".split()
LURES = ".pdf .doc .docx .xls .xlsx .ppt .pptx .txt .csv .jpg .jpeg .png .gif .zip".split()
NAME_TRIGGERS = r"(?i)ignore.*instruction|simulate.*response|act\s+as|pretend\s+to\s+be|<\|system\|>|\[system\]|unfiltered|/JavaScript"
PDF_MARKERS = [("/JavaScript", "file.pdf_javascript", "high"), ("/JS", "file.pdf_javascript", "high"), ("/OpenAction", "file.pdf_open_action", "high"), ("/AA", "file.pdf_open_action", "medium"), ("/Launch", "file.pdf_launch", "high"), ("/EmbeddedFile", "file.pdf_embedded", "medium"), ("/RichMedia", "file.pdf_richmedia", "medium")]
ZIP_TYPES, STREAM_TYPES, NO_READER = (".zip", ".docx", ".xlsx", ".pptx", ".jar"), (".gz", ".bz2", ".xz", ".svgz"), (".7z", ".rar")
MAX_ENTRIES, MAX_RATIO, MAX_UNPACKED, CHUNK, MAX_DEPTH = 1000, 100, 50 << 20, 1 << 20, 2
MAX_MB = 50.0
SVG_MARKS = [rb"<script\b", rb"\bon\w+\s*=", rb"javascript:", rb"<foreignObject\b"]
OOXML, MACRO_TYPES = (".docx", ".xlsx", ".pptx"), (".docm", ".xlsm", ".pptm", ".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt", ".bin")
# The first bytes of programs.
PROGRAM_MAGIC = [b"MZ", b"\x7fELF"]
BASE64_BLOB = r"[A-Za-z0-9+/]{200,}={0,2}"

_SVG_BYTES = re.compile(b"(?i)" + b"|".join(SVG_MARKS))
_ENTITY = re.compile(rb"(?i)<!ENTITY\b")
_JS_URI, _AWAY = re.compile(r"(?i)[\s\x00-\x20]*javascript:"), re.compile(r"(?i)\s*(?:[a-z][a-z0-9+.\-]*:)?//")
_TRIGGER, _BASE64 = re.compile(NAME_TRIGGERS), re.compile(BASE64_BLOB)

FINDING = "array<struct<category:string,severity:string>>"


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _name() -> Column:
    return F.lower(F.element_at(F.split("path", "/"), -1))


def name_findings(files: DataFrame, max_mb: float = MAX_MB) -> DataFrame:
    """(path, category, severity) from names, sizes and first bytes, in native columns: extension, double extension, name, program, size."""
    name = _name()
    parts = F.split(name, r"\.")
    ext = F.when(F.size(parts) > 1, F.concat(F.lit("."), F.element_at(parts, -1)))
    inner = F.when(F.size(parts) > 2, F.concat(F.lit("."), F.try_element_at(parts, F.lit(-2))))
    tests = [
        (ext.isin(SUSPICIOUS), "file.suspicious_extension", "high"),
        (inner.isin(LURES) & ext.isin(SUSPICIOUS), "file.double_extension", "high"),
        (F.regexp_like(name, F.lit(NAME_TRIGGERS)), "file.suspicious_filename", "medium"),
        (F.coalesce(*[F.when(F.startswith(F.col("content"), F.lit(bytearray(m))), True) for m in PROGRAM_MAGIC], F.lit(False)) if "content" in files.columns else F.lit(False), "file.suspicious_mime", "high"),
        (F.col("length") > int(max_mb * (1 << 20)), "file.size_exceeded", "medium"),
    ]
    each = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))) for t, c, s in tests]))
    return files.select("path", F.explode(each).alias("f")).select("path", "f.*")


def pdf_findings(files: DataFrame) -> DataFrame:
    """(path, category, severity) of PDF markers, of a category the first one, in native columns."""
    raw = F.decode("content", "ISO-8859-1")
    first: dict[str, Column] = {}
    for marker, category, severity in PDF_MARKERS:
        first[category] = F.coalesce(first[category], F.when(F.instr(raw, marker) > 0, severity)) if category in first else F.when(F.instr(raw, marker) > 0, severity)
    each = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(F.lit(c).alias("category"), s.alias("severity"))) for c, s in first.items()]))
    return files.filter(_name().endswith(".pdf")).select("path", F.explode(each).alias("f")).select("path", "f.*")


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, category, severity) of wanted paths that aren't there."""
    return wanted.select("path").join(files.select("path"), "path", "left_anti").select("path", F.lit("file.not_found").alias("category"), F.lit("high").alias("severity"))


# In Python: containers and XML ----------------------------------------------------------------------------------------


def unpack_stream(data: bytes, ext: str, limit: int) -> tuple[bytes, bool]:
    """(the first limit bytes and one chunk at most of a compressed stream, whether it ended within)."""
    opener = {".gz": gzip, ".tgz": gzip, ".svgz": gzip, ".bz2": bz2, ".xz": lzma}[ext]
    out = io.BytesIO()
    with opener.open(io.BytesIO(data), "rb") as f:
        while out.tell() <= limit:
            part = f.read(CHUNK)
            if not part:
                return out.getvalue(), True
            out.write(part)
    return out.getvalue(), False


def zip_bomb(data: bytes, max_mb: float, depth: int = 0) -> bool:
    """Whether a zip's directory, or that of a zip in it, shows a bomb.

    Nothing is unpacked but nested archives, whole; one that is larger than a whole archive may be is a bomb itself,
    whatever the directory says of it.
    """
    limit = int(max_mb * (1 << 20))
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = z.infolist()
            packed, full = sum(e.compress_size for e in entries), sum(e.file_size for e in entries)
            if len(entries) > MAX_ENTRIES or full > limit or (packed and full > MAX_UNPACKED and full > MAX_RATIO * packed):
                return True
            for e in entries if depth < MAX_DEPTH else ():
                if e.filename.lower().endswith(ZIP_TYPES):
                    with z.open(e) as f:
                        inner = f.read(limit + 1)
                    if len(inner) > limit or zip_bomb(inner, max_mb, depth + 1):
                        return True
    except (zipfile.BadZipFile, OSError, zlib.error, NotImplementedError, RuntimeError, EOFError):
        pass
    return False


def archive_findings(name: str, data: bytes, max_mb: float = MAX_MB) -> list[tuple[str, str]]:
    """Bombs first; then, in a tar, members that leave the folder and links."""
    path = PurePosixPath(name.lower())
    ext, suffixes = path.suffix, path.suffixes
    if ext in NO_READER:
        return [("file.unscannable_archive", "medium")]
    if ext in ZIP_TYPES and zip_bomb(data, max_mb):
        return [("file.archive_bomb", "high")]
    try:
        if ext in STREAM_TYPES or ext == ".tgz":
            got, ended = unpack_stream(data, ext, int(max_mb * (1 << 20)))
            if not ended or (len(got) > MAX_UNPACKED and len(got) > MAX_RATIO * max(1, len(data))):
                return [("file.archive_bomb", "high")]
        if ".tar" in suffixes or ext == ".tgz":
            out = []
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                members = t.getmembers()
            if any(m.name.startswith("/") or ".." in PurePosixPath(m.name).parts for m in members):
                out.append(("file.archive_escape", "high"))
            if any(m.issym() or m.islnk() for m in members):
                out.append(("file.archive_escape", "high"))
            return out
    except (OSError, EOFError, zlib.error, lzma.LZMAError, tarfile.TarError):
        pass
    return []


def _svg(name: str, data: bytes, max_mb: float) -> bytes:
    return unpack_stream(data, ".svgz", int(max_mb * (1 << 20)))[0] if name.lower().endswith(".svgz") else data


def svg_findings(name: str, data: bytes, max_mb: float = MAX_MB) -> list[tuple[str, str]]:
    """Byte patterns on the whole; then, unless entities are declared, elements and attributes of the tree."""
    try:
        data = _svg(name, data, max_mb)
    except (OSError, EOFError, zlib.error):
        return []
    found = {"file.svg_script": "high"} if _SVG_BYTES.search(data) else {}
    if _ENTITY.search(data):
        return [*found.items(), ("file.svg_entity_decl", "medium")]
    local = lambda n: n.rpartition("}")[2].lower() if isinstance(n, str) else ""
    try:
        for e in ElementTree.fromstring(data).iter():
            tag, attributes = local(e.tag), [(local(k), v) for k, v in e.attrib.items()]
            if tag in ("script", "foreignobject") or any(k.startswith("on") or _JS_URI.match(v) for k, v in attributes):
                found["file.svg_script"] = "high"
            if tag in ("image", "use", "feimage") and any(k in ("href", "src") and _AWAY.match(v) for k, v in attributes):
                found["file.svg_external_ref"] = "medium"
    except ElementTree.ParseError:
        pass
    return list(found.items())


def ooxml_findings(data: bytes) -> list[tuple[str, str]]:
    """Base64 blobs and triggers in the XML parts of a package, read whole; call it for packages that are no bombs."""
    found: dict[str, str] = {}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in z.namelist():
                if n.endswith((".xml", ".rels")):
                    content = z.read(n).decode("utf-8", "ignore")
                    if _BASE64.search(content):
                        found["file.ooxml_base64"] = "medium"
                    if _TRIGGER.search(content):
                        found["file.ooxml_injection"] = "high"
    except (zipfile.BadZipFile, OSError, zlib.error, NotImplementedError, RuntimeError, EOFError):
        pass
    return list(found.items())


def ole_streams(data: bytes) -> dict[str, bytes]:
    """Name -> content of the streams of a compound file (the public MS-CFB format); {} for anything else."""
    if not data.startswith(bytes.fromhex("D0CF11E0A1B11AE1")) or len(data) < 512:
        return {}
    u32 = lambda at: int.from_bytes(data[at : at + 4], "little")
    size, mini, cutoff, last = 1 << data[30], 1 << data[32], u32(56), 0xFFFFFFFA
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    ints = lambda raw: [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw) - 3, 4)]
    fat_at, more, seen = [x for x in ints(data[76:512]) if x < last], u32(68), set()
    while more < last and more not in seen:  # further lists of the allocation table's sectors
        seen.add(more)
        *part, more = ints(sector(more))
        fat_at += [x for x in part if x < last]
    fat = [x for n in fat_at for x in ints(sector(n))]

    def chain(start: int, table: list[int], get) -> bytes:
        out, n, been = [], start, set()
        while n < len(table) and n not in been:
            been.add(n)
            out.append(get(n))
            n = table[n]
        return b"".join(out)

    folder = chain(u32(48), fat, sector)
    entries = []
    for at in range(0, len(folder) - 127, 128):
        e = folder[at : at + 128]
        name = e[: max(0, int.from_bytes(e[64:66], "little") - 2)].decode("utf-16-le", "replace")
        entries.append((name, e[66], int.from_bytes(e[116:120], "little"), int.from_bytes(e[120:124], "little")))
    mini_fat = ints(chain(u32(60), fat, sector))
    small = chain(next((s for _, kind, s, _ in entries if kind == 5), last), fat, sector)
    piece = lambda n: small[n * mini : (n + 1) * mini]
    return {name: (chain(start, fat, sector) if n >= cutoff else chain(start, mini_fat, piece))[:n] for name, kind, start, n in entries if kind == 2}


def unpack_vba(data: bytes) -> bytes:
    """The text of a compressed macro container (the public MS-OVBA format)."""
    out, at = bytearray(), 1
    if data[:1] != b"\x01":
        raise ValueError("no macro container")
    while at + 2 <= len(data):
        head = int.from_bytes(data[at : at + 2], "little")
        end, start = min(len(data), at + (head & 0xFFF) + 3), len(out)
        at += 2
        if not head & 0x8000:
            out += data[at : at + 4096]
            at = end
            continue
        while at < end:
            flags, at = data[at], at + 1
            for bit in range(8):
                if at >= end:
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token = int.from_bytes(data[at : at + 2], "little")
                at += 2
                width = max(4, (len(out) - start - 1).bit_length())
                back, n = (token >> (16 - width)) + 1, (token & (0xFFFF >> width)) + 3
                if back > len(out):
                    raise ValueError("a copy from before the start")
                for _ in range(n):
                    out.append(out[-back])
    return bytes(out)


def macro_texts(data: bytes) -> list[str]:
    """Source texts of the macros in a compound file, or in a package's vbaProject.bin."""
    if data.startswith(b"PK"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [t for n in z.namelist() if n.lower().endswith("vbaproject.bin") for t in macro_texts(z.read(n))]
        except (zipfile.BadZipFile, OSError, zlib.error, NotImplementedError, RuntimeError, EOFError):
            return []
    out = []
    for raw in ole_streams(data).values():
        # a module's source follows its compiled form, and begins with the packed word Attribute
        at = raw.find(b"\x00Attribut")
        if at >= 3:
            try:
                out.append(unpack_vba(raw[at - 3 :]).decode("latin-1"))
            except (ValueError, IndexError):
                out.append("")
    return out


def macro_findings(data: bytes) -> list[tuple[str, str]]:
    """Macros, and triggers in their source: the one critical finding."""
    texts = macro_texts(data)
    found = [("file.office_macros", "high")] if texts else []
    return found + ([("file.macro_injection", "critical")] if any(map(_TRIGGER.search, texts)) else [])


def exif_strings(data: bytes) -> dict[int, str]:
    """Tag -> text of the ASCII fields in a JPEG's, PNG's or TIFF's EXIF block, its sub-block included; {} without one."""
    at = data.find(b"Exif\x00\x00") + 6 if data.startswith(b"\xff\xd8") else data.find(b"eXIf") + 4 if data.startswith(b"\x89PNG") else 0
    tiff = data[at:] if at >= 4 or at == 0 else b""
    order = {b"II*\x00": "little", b"MM\x00*": "big"}.get(tiff[:4])
    if order is None:
        return {}
    number = lambda at, n: int.from_bytes(tiff[at : at + n], order)
    out, todo, seen = {}, [number(4, 4)], set()
    while todo:
        block = todo.pop()
        if block in seen or not 8 <= block < len(tiff) - 2:
            continue
        seen.add(block)
        n = number(block, 2)
        for e in range(block + 2, min(block + 2 + 12 * n, len(tiff) - 11), 12):
            tag, kind, count = number(e, 2), number(e + 2, 2), number(e + 4, 4)
            if kind == 2:
                start = e + 8 if count <= 4 else number(e + 8, 4)
                out[tag] = tiff[start : start + count].split(b"\x00")[0].decode("utf-8", "replace")
            elif tag in (0x8769, 0x8825):  # the EXIF and the position block
                todo.append(number(e + 8, 4))
        todo.append(number(block + 2 + 12 * n, 4))
    return out


def exif_findings(data: bytes) -> list[tuple[str, str]]:
    return [("file.exif_injection", "high")] if any(map(_TRIGGER.search, exif_strings(data).values())) else []


def document_text(name: str, data: bytes, max_mb: float = MAX_MB) -> str:
    """Plain text of a file: OOXML parts as their character data, mark-up and text as UTF-8; "" for what needs a reader that isn't there."""
    ext = PurePosixPath(name.lower()).suffix
    try:
        if ext in OOXML:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                parts = [n for n in sorted(z.namelist()) if n.endswith(".xml") and not n.startswith("_rels")]
                return "\n".join(" ".join(ElementTree.fromstring(z.read(n)).itertext()) for n in parts)
        if ext in (".svg", ".svgz"):
            return _svg(name, data, max_mb).decode("utf-8", "ignore")
        if ext in (".txt", ".md", ".csv", ".json", ".xml", ".yaml", ".yml", ".html", ".htm", ".log", ".py", ".js", ".sh"):
            return data.decode("utf-8", "replace")
        if ext == ".pdf":
            from pypdf import PdfReader

            return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
    except Exception:  # noqa: BLE001 - a file that can't be read has no text
        return ""
    return ""


def xmp_text(data: bytes) -> str:
    """Character data and attribute values of XMP packets in any image, at least eight characters with a letter each."""
    out = []
    for packet in re.findall(rb"(?s)<x:xmpmeta\b.*?</x:xmpmeta>", data):
        if _ENTITY.search(packet):
            continue
        try:
            for e in ElementTree.fromstring(packet).iter():
                out += [s for s in (e.text or "", *e.attrib.values()) if len(s.strip()) >= 8 and any(map(str.isalpha, s))]
        except ElementTree.ParseError:
            continue
    return "\n".join(s.strip() for s in out)


def content_findings(files: DataFrame, max_mb: float = MAX_MB) -> DataFrame:
    """(path, category, severity) from archives, SVG, packages, macros and images, in Arrow batches of whole files."""

    @F.pandas_udf(FINDING)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, data in batches:
            out = []
            for n, d in zip(names, data, strict=True):
                f = archive_findings(n, d, max_mb)
                if ("file.archive_bomb", "high") not in f:  # what looks like a bomb isn't unpacked any further
                    f += svg_findings(n, d, max_mb) if n.endswith((".svg", ".svgz")) else []
                    f += ooxml_findings(d) if n.endswith(OOXML) else []
                    f += macro_findings(d) if n.endswith(MACRO_TYPES) else []
                    f += exif_findings(d) if d.startswith((b"\xff\xd8", b"\x89PNG", b"II*\x00", b"MM\x00*")) else []
                out.append([{"category": c, "severity": s} for c, s in f])
            yield pd.Series(out)

    return files.select("path", F.explode(run(_name(), F.col("content"))).alias("f")).select("path", "f.*")


def file_texts(files: DataFrame) -> DataFrame:
    """(path, text, metadata_text) for the text scanners; archives that look like bombs have no text."""

    @F.pandas_udf("text string, metadata_text string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, data in batches:
            bomb = [any(c == "file.archive_bomb" for c, _ in archive_findings(n, d)) for n, d in zip(names, data, strict=True)]
            yield pd.DataFrame({"text": ["" if x else document_text(n, d) for x, n, d in zip(bomb, names, data, strict=True)], "metadata_text": ["\n".join(filter(None, [*exif_strings(d).values(), xmp_text(d)])) for d in data]})

    return files.select("path", run(_name(), F.col("content")).alias("t")).select("path", "t.*")


def scan_files(files: DataFrame, max_mb: float = MAX_MB) -> DataFrame:
    """All structural findings of files."""
    return name_findings(files, max_mb).unionByName(pdf_findings(files)).unionByName(content_findings(files, max_mb))


def scan_file_texts(files: DataFrame) -> DataFrame:
    """Catalog findings of files' texts, and, under file.image_metadata., of their metadata."""
    from palisade.operators.catalog import scan_texts
    from palisade.plans.rules import catalog

    t = file_texts(files)
    body = scan_texts(t, "path", F.col("text"), [catalog("document_scan")], normalize=False)
    meta = scan_texts(t, "path", F.col("metadata_text"), [catalog("injection_scan")], normalize=False)
    return body.unionByName(meta.withColumn("category", F.concat(F.lit("file.image_metadata."), F.col("category"))).withColumn("score", F.lit(None).cast("double")))
