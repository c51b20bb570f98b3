"""Dependency manifests and lock files of about thirty formats as one table function: file name and content in, rows
(ecosystem, name, version, pin, lock) out. Each format is one small function over the text, chosen by file name; a file
that can't be parsed gives no rows. JSON and TOML are parsed by their libraries; YAML and the line formats by patterns.

pin is exact, range, any or none; version is the pinned version or the range as written."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = tuple[str, str, str | None, bool]
PARSERS: list[tuple[re.Pattern[str], Callable[[str], Iterator[Row]]]] = []
ROWS = "file string, ecosystem string, name string, version string, pin string, is_lockfile boolean"


def parser(pattern: str) -> Callable[[Callable[[str], Iterator[Row]]], Callable[[str], Iterator[Row]]]:
    def add(f: Callable[[str], Iterator[Row]]) -> Callable[[str], Iterator[Row]]:
        PARSERS.append((re.compile(pattern, re.I), f))
        return f

    return add


def pin_style(version: str | None) -> str:
    if version is None or version.strip() == "":
        return "none"
    v = version.strip()
    if v in ("*", "latest", "x", "any"):
        return "any"
    return "exact" if re.fullmatch(r"(==|=)?\s*v?\d[\w.+!-]*", v) else "range"


def _table(x: object) -> dict:
    return x if isinstance(x, dict) else {}


def _version(spec: object) -> str | None:
    return spec if isinstance(spec, str) else _table(spec).get("version")


@parser(r"(^|/)package\.json$")
def package_json(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for part in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        for name, spec in _table(doc.get(part)).items():
            yield "npm", name, _version(spec), False


@parser(r"(^|/)(package-lock|npm-shrinkwrap)\.json$")
def package_lock(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    if "packages" in doc:
        for path, entry in doc["packages"].items():
            if path:
                yield "npm", entry.get("name") or path.rpartition("node_modules/")[2], entry.get("version"), True
        return
    stack = [doc.get("dependencies") or {}]
    while stack:
        for name, entry in stack.pop().items():
            yield "npm", name, entry.get("version"), True
            stack.append(entry.get("dependencies") or {})


@parser(r"(^|/)yarn\.lock$")
def yarn_lock(text: str) -> Iterator[Row]:
    for block in re.split(r"\n(?=\S)", text):
        head = re.match(r'"?(@?[^@\s"]+)@[^\n]*:\s*$', block, re.M)
        version = re.search(r'^\s+version:?\s+"?([^"\s]+)"?', block, re.M)
        if head and version and not block.startswith(("#", "__metadata")):
            yield "npm", head[1], version[1], True


@parser(r"(^|/)pnpm-lock\.yaml$")
def pnpm_lock(text: str) -> Iterator[Row]:
    body = text.partition("\npackages:")[2] or ""
    for name, version in re.findall(r"^  '?/?((?:@[^/@\s]+/)?[^/@\s']+)[@/](\d[^(:'\s]*)[^:]*:\s*$", body, re.M):
        yield "npm", name, version, True


@parser(r"(^|/)pnpm-workspace\.yaml$")
def pnpm_catalog(text: str) -> Iterator[Row]:
    body = re.search(r"^catalogs?:\s*\n((?:[ \t]+.*\n?)*)", text, re.M)
    for name, spec in re.findall(r"""^\s+['"]?([@\w./-]+)['"]?:\s*['"]?([\^~]?\d[^'"\s]*)""", body[1] if body else "", re.M):
        yield "npm", name, spec, False


@parser(r"(^|/)requirements[^/]*\.txt$")
def requirements(text: str) -> Iterator[Row]:
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?=?[^;#\s]+\s*,?\s*)*)", line)
        if m and not line.lstrip().startswith(("#", "-")):
            yield "PyPI", m[1], m[2].strip() or None, False


def _pep508(spec: str) -> Row | None:
    m = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*\(?([^;)]*)", spec)
    return ("PyPI", m[1], m[2].strip() or None, False) if m else None


@parser(r"(^|/)pyproject\.toml$")
def pyproject(text: str) -> Iterator[Row]:
    doc = tomllib.loads(text)
    project = _table(doc.get("project"))
    groups = [project.get("dependencies") or [], *_table(project.get("optional-dependencies")).values(), *_table(doc.get("dependency-groups")).values(), _table(doc.get("build-system")).get("requires") or []]
    for spec in (s for g in groups for s in g if isinstance(s, str)):
        if row := _pep508(spec):
            yield row
    poetry = _table(_table(doc.get("tool")).get("poetry"))
    tables = [poetry.get("dependencies"), poetry.get("dev-dependencies"), *[_table(g).get("dependencies") for g in _table(poetry.get("group")).values()]]
    for name, spec in (x for t in tables for x in _table(t).items()):
        if name != "python":
            yield "PyPI", name, _version(spec), False


@parser(r"(^|/)(poetry|uv|pdm)\.lock$")
def python_lock(text: str) -> Iterator[Row]:
    for entry in tomllib.loads(text).get("package", []):
        yield "PyPI", entry["name"], entry.get("version"), True


@parser(r"(^|/)Pipfile\.lock$")
def pipfile_lock(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for part in ("default", "develop"):
        for name, entry in _table(doc.get(part)).items():
            yield "PyPI", name, (entry.get("version") or "").removeprefix("==") or None, True


@parser(r"(^|/)Pipfile$")
def pipfile(text: str) -> Iterator[Row]:
    doc = tomllib.loads(text)
    for part in ("packages", "dev-packages"):
        for name, spec in _table(doc.get(part)).items():
            yield "PyPI", name, _version(spec), False


@parser(r"(^|/)Cargo\.toml$")
def cargo_toml(text: str) -> Iterator[Row]:
    doc = tomllib.loads(text)
    for owner in [doc, *_table(doc.get("target")).values()]:
        for part in ("dependencies", "dev-dependencies", "build-dependencies"):
            for name, spec in _table(owner.get(part)).items():
                yield "crates.io", _table(spec).get("package") or name, _version(spec), False


@parser(r"(^|/)Cargo\.lock$")
def cargo_lock(text: str) -> Iterator[Row]:
    for entry in tomllib.loads(text).get("package", []):
        yield "crates.io", entry["name"], entry.get("version"), True


@parser(r"(^|/)go\.mod$")
def go_mod(text: str) -> Iterator[Row]:
    bare = re.sub(r"//.*", "", text)
    for block in re.findall(r"^require\s*\(([^)]*)\)", bare, re.M) + re.findall(r"^require\s+([^(\n]+)$", bare, re.M):
        for name, version in re.findall(r"(\S+)\s+(v\S+)", block):
            yield "Go", name, version, False


@parser(r"(^|/)go\.sum$")
def go_sum(text: str) -> Iterator[Row]:
    for name, version in dict.fromkeys(re.findall(r"^(\S+)\s+(v[^\s/]+)(?:/go\.mod)?\s+h1:", text, re.M)):
        yield "Go", name, version, True


@parser(r"(^|/)Gemfile$|\.gemspec$")
def gemfile(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"""^\s*(?:gem|\w+\.add_(?:development_|runtime_)?dependency)\s*\(?\s*['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""", text, re.M):
        yield "RubyGems", name, version or None, False


@parser(r"(^|/)Gemfile\.lock$")
def gemfile_lock(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"^    (\S+) \(([^)]+)\)$", text, re.M):
        yield "RubyGems", name, version, True


@parser(r"(^|/)composer\.json$")
def composer_json(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for part in ("require", "require-dev"):
        for name, spec in _table(doc.get(part)).items():
            if "/" in name:
                yield "Packagist", name, spec, False


@parser(r"(^|/)composer\.lock$")
def composer_lock(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for entry in (doc.get("packages") or []) + (doc.get("packages-dev") or []):
        yield "Packagist", entry["name"], entry.get("version"), True


@parser(r"(^|/)pom\.xml$")
def pom(text: str) -> Iterator[Row]:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
    values = {p.tag: (p.text or "").strip() for block in root.findall("properties") for p in block}
    values |= {"project.version": (root.findtext("version") or "").strip()}
    for dep in root.iter("dependency"):
        version = re.sub(r"\$\{([^}]+)\}", lambda m: values.get(m[1], m[0]), (dep.findtext("version") or "").strip())
        yield "Maven", f"{(dep.findtext('groupId') or '').strip()}:{(dep.findtext('artifactId') or '').strip()}", version or None, False


@parser(r"(^|/)build\.gradle(\.kts)?$")
def gradle(text: str) -> Iterator[Row]:
    for group, name, version in re.findall(r"""\b(?:implementation|api|compileOnly|runtimeOnly|testImplementation|classpath|annotationProcessor)\s*\(?\s*['"]([^:'"]+):([^:'"]+)(?::([^'":@]+))?['"]""", text):
        yield "Maven", f"{group}:{name}", version or None, False


@parser(r"(^|/)gradle\.lockfile$")
def gradle_lock(text: str) -> Iterator[Row]:
    for group, name, version in re.findall(r"^([^:#\s]+):([^:\s]+):([^=\s]+)=", text, re.M):
        yield "Maven", f"{group}:{name}", version, True


@parser(r"\.versions\.toml$")
def version_catalog(text: str) -> Iterator[Row]:
    doc = tomllib.loads(text)
    versions = _table(doc.get("versions"))
    for spec in _table(doc.get("libraries")).values():
        if isinstance(spec, str):
            group, name, version = [*spec.split(":"), None, None][:3]
            yield "Maven", f"{group}:{name}", version, False
        else:
            version = spec.get("version")
            version = _version(versions.get(version["ref"])) if isinstance(version, dict) and "ref" in version else version
            yield "Maven", spec.get("module") or f"{spec.get('group')}:{spec.get('name')}", version if isinstance(version, str) else None, False


@parser(r"(^|/)packages\.lock\.json$")
def nuget_lock(text: str) -> Iterator[Row]:
    for framework in _table(json.loads(text).get("dependencies")).values():
        for name, entry in framework.items():
            yield "NuGet", name, entry.get("resolved"), True


@parser(r"\.(cs|fs|vb)proj$|(^|/)Directory\.Packages\.props$")
def msbuild(text: str) -> Iterator[Row]:
    if "<!DOCTYPE" in text:
        return
    for node in ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1)).iter():
        if node.tag in ("PackageReference", "PackageVersion") and (node.get("Include") or node.get("Update")):
            yield "NuGet", node.get("Include") or node.get("Update") or "", node.get("Version") or node.findtext("Version"), False


@parser(r"\.sln$")
def solution(text: str) -> Iterator[Row]:
    for name, path in re.findall(r'^Project\("\{[^}]+\}"\)\s*=\s*"([^"]+)",\s*"([^"]+\.\w+proj)"', text, re.M):
        yield "project", name, path.replace("\\", "/"), False


@parser(r"(^|/)conanfile\.(txt|py)$")
def conan(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"""(?:^|['"\s(,\[])([a-z0-9_+.-]{2,})/(\[[^\]]+\]|[\w.+-]+)(?=[@#'"\s,)]|$)""", text, re.M):
        yield "ConanCenter", name, version, False


@parser(r"(^|/)conan\.lock$")
def conan_lock(text: str) -> Iterator[Row]:
    doc = json.loads(text)
    for part in ("requires", "build_requires", "python_requires"):
        for ref in doc.get(part) or []:
            name, _, version = ref.partition("#")[0].partition("/")
            yield "ConanCenter", name, version.partition("@")[0] or None, True


@parser(r"(^|/)vcpkg\.json$")
def vcpkg(text: str) -> Iterator[Row]:
    for entry in json.loads(text).get("dependencies") or []:
        yield ("vcpkg", entry, None, False) if isinstance(entry, str) else ("vcpkg", entry["name"], entry.get("version>="), False)


@parser(r"(^|/)CMakeLists\.txt$|\.cmake$")
def cmake_fetch(text: str) -> Iterator[Row]:
    for name, body in re.findall(r"FetchContent_Declare\s*\(\s*(\S+)([^)]*)\)", text, re.I):
        tag = re.search(r"GIT_TAG\s+(\S+)", body)
        yield "cmake", name, tag[1] if tag else None, False


@parser(r"(^|/)\.gitmodules$")
def gitmodules(text: str) -> Iterator[Row]:
    for name, body in re.findall(r'\[submodule "([^"]+)"\]([^\[]*)', text):
        url = re.search(r"url\s*=\s*(\S+)", body)
        yield "git", url[1] if url else name, None, False


def _image(ref: str) -> Row:
    digest = ref.partition("@")
    name, _, tag = digest[0].rpartition(":") if ":" in digest[0].rpartition("/")[2] else (digest[0], "", "")
    return "docker", name, digest[2] or tag or None, False


@parser(r"(^|/)(docker-)?compose[^/]*\.ya?ml$|(^|/)(k8s|kubernetes|manifests|deploy)[^/]*/.*\.ya?ml$|(^|/)deployment[^/]*\.ya?ml$")
def yaml_images(text: str) -> Iterator[Row]:
    for ref in re.findall(r"""^\s*(?:-\s+)?image:\s*['"]?([^'"\s#]+)""", text, re.M):
        yield _image(ref)


@parser(r"(^|/)\.gitlab-ci\.ya?ml$")
def gitlab_ci(text: str) -> Iterator[Row]:
    for ref in re.findall(r"""^\s*(?:image|-?\s*name):\s*['"]?([\w./-]+(?::[\w.-]+)?(?:@sha256:[0-9a-f]+)?)['"]?\s*$""", text, re.M):
        yield _image(ref)


@parser(r"(^|/)\.pre-commit-config\.ya?ml$")
def precommit(text: str) -> Iterator[Row]:
    for repo, rev in re.findall(r"""-\s+repo:\s*['"]?(\S+?)['"]?\s*\n\s+rev:\s*['"]?([^'"\s#]+)""", text):
        yield "pre-commit", repo, rev, False


@parser(r"(^|/)Chart\.(ya?ml|lock)$")
def helm(text: str) -> Iterator[Row]:
    body = text.partition("dependencies:")[2]
    for block in re.split(r"^\s*-\s", body, flags=re.M)[1:]:
        name, version = re.search(r"""name:\s*['"]?([^'"\s]+)""", block), re.search(r"""version:\s*['"]?([^'"\n]+?)['"]?\s*$""", block, re.M)
        if name:
            yield "helm", name[1], version[1] if version else None, "digest:" in text


@parser(r"(^|/)(Dockerfile|Containerfile)[^/]*$|\.dockerfile$")
def dockerfile(text: str) -> Iterator[Row]:
    stages = set(re.findall(r"^\s*FROM\s+.*\s+AS\s+(\S+)", text, re.M | re.I))
    for ref in re.findall(r"^\s*FROM\s+(?:--\S+\s+)*(\S+)", text, re.M | re.I):
        if ref not in stages and ref != "scratch":
            yield _image(ref)
    for name, version in re.findall(r"""^\s*ARG\s+(\w+?)_VERSION=['"]?([^'"\s]+)""", text, re.M):
        yield "generic", name.lower(), version, False


@parser(r"(^|/)\.github/workflows/[^/]+\.ya?ml$|(^|/)action\.ya?ml$")
def workflow(text: str) -> Iterator[Row]:
    for name, ref in re.findall(r"""^\s*(?:-\s+)?uses:\s*['"]?([\w.-]+/[\w./-]+)@([^'"\s#]+)""", text, re.M):
        yield "actions", name, ref, False


def parse(file: str, text: str) -> list[tuple[str, str, str, str | None, str, bool]]:
    """Rows of one file; none for unknown names and content that can't be parsed."""
    for pattern, read in PARSERS:
        if pattern.search(file):
            try:
                return [(file, e, n, v, pin_style(v), lock) for e, n, v, lock in read(text) if n]
            except (ValueError, KeyError, TypeError, AttributeError, ET.ParseError, RecursionError):
                return []
    return []


def dependencies(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """One row per declared or locked dependency of each file (see ROWS)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for f, t in zip(pdf["f"], pdf["t"]) for r in parse(f, t)]
            yield pd.DataFrame(rows, columns=["file", "ecosystem", "name", "version", "pin", "is_lockfile"])

    return files.where(F.col(file).isNotNull() & F.col(text).isNotNull()).select(F.col(file).alias("f"), F.col(text).alias("t")).mapInPandas(run, ROWS)
