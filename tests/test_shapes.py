"""Shapes of documents against a walk over the parsed ones."""

import json
import random

from newsloom.operators import drift as D


def kinds(value, path="$", out=None):
    """Kinds of values per path of one document, as a set."""
    out = {} if out is None else out
    name = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    out.setdefault(path, set()).add(name)
    for k, v in value.items() if isinstance(value, dict) else ():
        kinds(v, f"{path}.{k}", out)
    if isinstance(value, list):
        for v in value:
            kinds(v, f"{path}[]", out)
        if not value:
            out.setdefault(f"{path}[]", set()).add("null")
    return out


def shape(docs):
    """Merged kinds; a part that is of several kinds hides what is below it."""
    seen: dict[str, set] = {}
    for d in docs:
        for p, ks in kinds(d).items():
            seen.setdefault(p, set()).update(ks)
    one = {p: (ks - {"null"} if len(ks) > 1 else ks) for p, ks in seen.items()}
    out = {p: next(iter(ks)) if len(ks) == 1 else "mixed" for p, ks in one.items()}
    mixed = [p for p, k in out.items() if k == "mixed"]
    return {p: k for p, k in out.items() if not any(p.startswith((f"{m}.", f"{m}[]")) for m in mixed)}


def test_paths():
    got = D.schema_paths("OBJECT<`a ``b`: ARRAY<ARRAY<OBJECT<c: DECIMAL(3,1)>>>, STRING: VOID, `x.y`: OBJECT<>, z: BIGINT>")
    assert dict(got) == {
        "$": "object", "$.a `b": "array", "$.a `b[]": "array", "$.a `b[][]": "object", "$.a `b[][].c": "number",
        "$.STRING": "null", "$.x.y": "object", "$.z": "number",
    }
    assert D.schema_paths("BIGINT") == [("$", "number")]


def random_value(rng, depth=0):
    pick = rng.randint(0, 9 if depth < 3 else 6)
    if pick >= 8:
        return {rng.choice(["a", "b b", "c.d", "ö", "OBJECT", "`q`"]): random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    if pick == 7:
        return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return [1, 2.5, 1e40, "text", "", True, None][pick]


def test_shapes_and_drift(spark):
    rng = random.Random(3)
    rows, want, counts = [], {}, {}
    for source in ("s", None, "odd"):
        for run in range(12):
            docs = [{"k": random_value(rng), "m": random_value(rng)} for _ in range(rng.randint(0, 3))]
            bad = [None, "", "{", '"x'][: rng.randint(0 if docs else 1, 4)]
            rows += [(source, run, json.dumps(x), 1) for x in docs] + [(source, run, x, 1) for x in bad]
            want[(source, run)], counts[(source, run)] = shape(docs) if docs else {}, (len(docs) + len(bad), len(bad))
    docs = spark.createDataFrame(rows, "source string, run_date int, payload string, _value int").repartition(5)
    shapes = D.run_shapes(docs, ["source"])
    got = {(r.source, r.run_date): r for r in shapes.collect()}
    assert {k: r.paths for k, r in got.items()} == want
    assert {k: (r.documents, r.broken) for k, r in got.items()} == counts
    expect = set()
    for source in ("s", None, "odd"):
        told = [run for run in range(12) if want[(source, run)]]
        for old, new in zip(told, told[1:]):
            a, b = want[(source, old)], want[(source, new)]
            for p in a.keys() | b.keys():
                if a.get(p) != b.get(p):
                    change = "added" if p not in a else "removed" if p not in b else "changed"
                    expect.add((source, new, old, p, a.get(p), b.get(p), change))
    found = [tuple(r) for r in D.shape_drift(shapes, ["source"]).collect()]
    assert len(found) == len(set(found)) and set(found) == expect
    assert {r[-1] for r in found} == {"added", "removed", "changed"}
    trailing = spark.createDataFrame([("s", 1, '{"a": 1} x')], "source string, run_date int, payload string")
    assert D.run_shapes(trailing, ["source"]).first().paths == {"$": "object", "$.a": "number"}
    assert D.shape_drift(D.run_shapes(docs.limit(0), ["source"]), ["source"]).count() == 0
