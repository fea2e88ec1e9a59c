"""Template packages: signatures over files, deterministic archives, verification, rendering."""

from __future__ import annotations

import hashlib
import io
import posixpath
import secrets
import zipfile
from datetime import date
from typing import Any

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.templates import final_newline, render

MANIFEST, SIGNATURE = "manifest.yaml", "SIGNATURE.yaml"
MANIFESTS = (MANIFEST, "template.yml", "template.yaml")


class PackageError(ValueError):
    pass


def checksums(files: DataFrame) -> DataFrame:
    """files(path, content binary) -> (path, sha256, size)"""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def digest(files: DataFrame) -> DataFrame:
    """(digest): of the lines "path sha256" in the order of their paths. A package is small; its lines meet in one row."""
    lines = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    payload = F.concat_ws("\n", F.transform(lines, lambda x: F.concat_ws(" ", x["path"], x["sha256"])))
    return checksums(files).where(F.col("path") != SIGNATURE).agg(F.sha2(payload, 256).alias("digest"))


def verify(files: DataFrame, signed: DataFrame) -> DataFrame:
    """(path, problem) of files against signed(path, sha256, size): missing, unsigned, size or checksum."""
    own = checksums(files).where(F.col("path") != SIGNATURE).select("path", F.col("sha256").alias("have"), F.col("size").alias("bytes"))
    both = own.join(signed.select("path", "sha256", "size"), "path", "full_outer")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "unsigned").when(F.col("bytes") != F.col("size"), "size").when(F.col("have") != F.col("sha256"), "checksum")
    return both.select("path", problem.alias("problem")).where("problem is not null").orderBy("path")


def safe(path: str) -> str:
    if not path or path.startswith(("/", "\\")) or ".." in posixpath.normpath(path).split("/") or ":" in path.split("/")[0]:
        raise PackageError(f"unsafe path {path!r}")
    return path


def sign(files: dict[str, bytes]) -> dict[str, Any]:
    rows = [{"path": p, "sha256": hashlib.sha256(c).hexdigest(), "size": len(c)} for p, c in sorted(files.items()) if p != SIGNATURE]
    payload = "\n".join(f"{r['path']} {r['sha256']}" for r in rows)
    return {"version": "1", "policy": "checksum-only", "algorithm": "sha256", "scope": "file_contents_relative_paths_deterministic_order", "files": rows, "digest": hashlib.sha256(payload.encode()).hexdigest()}


#: Folders of languages in a package, looked through before its root.
LANGUAGES = ("en", "pt_br")


def absent(files: dict[str, bytes]) -> list[str]:
    """Paths that the manifest names (templates of files, instructions) and the package doesn't hold in any language."""
    spec = manifest(files)
    named = [f.get("template") if isinstance(f, dict) else None for f in spec.get("files") or []] + list(spec.get("instructions") or [])
    if not all(isinstance(p, str) for p in named):
        raise PackageError("files need a template and a target, instructions are paths")
    folders = {p.rsplit("/", i)[0] for p in files for i in range(1, p.count("/") + 1)}
    return [p for p in named if not any(at in files or at in folders for at in (f"{g}/{safe(p)}" if g else p for g in (*LANGUAGES, "")))]


def pack(files: dict[str, bytes]) -> bytes:
    """A zip that is the same for the same files: sorted entries, one date, one mode."""
    if MANIFEST not in files:
        raise PackageError(f"a package needs {MANIFEST}")
    own = {safe(p): c for p, c in files.items() if p != SIGNATURE}
    missing = absent(own)
    if missing:
        raise PackageError(f"the manifest names what is not there: {', '.join(missing)}")
    own[SIGNATURE] = yaml.safe_dump(sign(own), sort_keys=False).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(own):
            entry = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            entry.external_attr, entry.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
            z.writestr(entry, own[path])
    return out.getvalue()


def unpack(archive: bytes, checksum: str | None = None) -> dict[str, bytes]:
    """The verified files of an archive; without a signature they are as they are."""
    if checksum is not None and hashlib.sha256(archive).hexdigest() != checksum.lower().removeprefix("sha256:"):
        raise PackageError("the archive's checksum differs")
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        files = {safe(i.filename): z.read(i) for i in z.infolist() if not i.is_dir()}
    if not any(m in files for m in MANIFESTS):
        raise PackageError("the archive has no manifest")
    if SIGNATURE in files:
        signed, now = yaml.safe_load(files[SIGNATURE]), sign(files)
        if signed.get("digest") != now["digest"] or signed.get("files") != now["files"]:
            raise PackageError("the files differ from the signature")
    return files


def manifest(files: dict[str, bytes]) -> dict[str, Any]:
    name = next(m for m in MANIFESTS if m in files)
    value = yaml.safe_load(files[name])
    if not isinstance(value, dict) or not value.get("name"):
        raise PackageError("the manifest names no package")
    for v in value.get("variables") or []:
        if not str(v.get("name", "")).isidentifier():
            raise PackageError(f"variable {v.get('name')!r} is no identifier")
    return value


def instantiate(files: dict[str, bytes], values: dict[str, Any], lang: str = "en", today: date | None = None) -> dict[str, str]:
    """Rendered text by target path. Given values win over the manifest's defaults; a required variable without one is an error.

    created_at and updated_at are today's date where neither gives them.
    """
    spec, scope = manifest(files), {}
    for v in spec.get("variables") or []:
        given = values.get(v["name"], v.get("default"))
        if given is None and v.get("required"):
            raise PackageError(f"variable {v['name']!r} is required")
        scope[v["name"]] = "" if given is None else given
    scope.update(values)
    for name in ("created_at", "updated_at"):
        scope.setdefault(name, (today or date.today()).isoformat())
    out = {}
    for f in spec.get("files") or []:
        source = next((p for p in (f"{lang}/{f['template']}", f["template"], f"en/{f['template']}") if p in files), None)
        if source is None:
            raise PackageError(f"no template {f['template']!r}")
        text = files[source].decode()
        out[safe(render(f["target"], scope))] = final_newline(render(text, scope) if source.endswith((".j2", ".jinja")) else text)
    return out


def discover(folder: dict[str, dict[str, bytes]]) -> list[tuple[str, str, str]]:
    """(name, folder, description) of the packages in files by folder, in the order of their folders; a manifest that can't be read leaves the folder's name."""
    out = []
    for at, files in sorted(folder.items()):
        if MANIFEST in files:
            try:
                spec = yaml.safe_load(files[MANIFEST]) or {}
            except yaml.YAMLError:
                spec = {}
            spec = spec if isinstance(spec, dict) else {}
            out.append((str(spec.get("name", at)), at, str(spec.get("description", ""))))
    return out


def phrase(words: int = 5) -> str:
    """Random words of two or three syllables."""
    syllables = [c + v for c in "bdfgklmnprstv" for v in "aeiou"]
    return " ".join("".join(secrets.choice(syllables) for _ in range(2 + secrets.randbelow(2))) for _ in range(words))
