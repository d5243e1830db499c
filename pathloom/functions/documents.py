"""Functions on document objects: extensions, references, and services outside the document.

Services (a resolver, a terminology, a profile check) are callables of the call's options.  Over
DataFrames, pathloom.operators.references expresses the same functions as joins.
"""

from __future__ import annotations

from pathloom.functions.registry import function
from pathloom.plans.types import EXTENSION_VALUES
from pathloom.plans.values import Obj, from_json, root_values


def extensions(items: list, url: list) -> list[Obj]:
    if not url or not isinstance(url[0], str):
        return []
    return [e for x in items if isinstance(x, Obj) for e in from_json(x.fields.get("extension", "null")) if isinstance(e, Obj) and e.plain_field("url") == str(url[0])]


@function("extension", 1)
def _extension(call, items, url):
    return extensions(items, url)


@function("hasExtension", 1)
def _has_extension(call, items, url):
    return [bool(extensions(items, url))]


@function("getExtensionValue", 1)
def _extension_value(call, items, url):
    out = []
    for e in extensions(items, url):
        name = next((f for f in EXTENSION_VALUES if f in e.fields), None)
        if name:
            out += from_json(e.fields[name])
    return out


def reference_of(x) -> str | None:
    if isinstance(x, str):
        return str(x)
    found = x.plain_field("reference") if isinstance(x, Obj) else None
    return found if isinstance(found, str) else None


@function("getReferenceKey", 0, 1)
def _reference_key(call, items, part=()):
    out = []
    for ref in map(reference_of, items):
        pieces = [p for p in (ref or "").split("/") if p]
        if len(pieces) >= 2:
            kind, key = pieces[-2:]
            wanted = part[0] if part else None
            out.append(kind if wanted == "type" else key if wanted == "id" else f"{kind}/{key}")
    return out


@function("resolve")
def _resolve(call, items):
    out = []
    if call.resolver:
        for ref in map(reference_of, items):
            try:
                found = call.resolver(ref) if ref else None
            except Exception:  # a resolver's failure skips the reference
                continue
            out += root_values(found)
    return out


def codes(x) -> list[tuple[str | None, str]]:
    """(system, code) of a code, coding or concept."""
    if isinstance(x, str):
        return [(None, str(x))]
    if not isinstance(x, Obj):
        return []
    if "coding" in x.fields:
        return [c for y in from_json(x.fields["coding"]) for c in codes(y)]
    code = x.plain_field("code")
    return [(x.plain_field("system"), code)] if isinstance(code, str) else []


@function("memberOf", 1)
def _member_of(call, items, url):
    if not call.terminology or not url or not items:
        return []
    for x in items:
        for system, code in codes(x):
            try:
                if call.terminology(str(url[0]), system, code):
                    return [True]
            except Exception:  # a service's failure skips the code
                continue
    return [False]


@function("conformsTo", 1)
def _conforms_to(call, items, url):
    if not call.profiles or not url:
        return []
    for x in items:
        if isinstance(x, Obj):
            try:
                return [bool(call.profiles(x.raw, str(url[0])))]
            except Exception:  # the next object may be judged
                continue
    return []
