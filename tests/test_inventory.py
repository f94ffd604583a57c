"""Path inventory against walking each text."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators.inventory import path_inventory

KIND = {dict: "object", list: "array", str: "text", int: "integer", float: "decimal", bool: "boolean", type(None): "null"}


def step(key):
    if key.isascii() and key.isidentifier():
        return "." + key
    return '["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def walk(value, path, found):
    found[path, KIND[type(value)]] += 1
    if isinstance(value, dict):
        for key, part in value.items():
            walk(part, path + step(key), found)
    elif isinstance(value, list):
        for part in value:
            walk(part, path + "[*]", found)


def brute(texts):
    found = Counter()
    for text in texts:
        if text is None:
            continue
        try:
            value = json.loads(text)
        except ValueError:
            found["$", "no json"] += 1
            continue
        walk(value, "$", found)
    return found


def inventory(spark, texts):
    df = spark.createDataFrame([(t, 1, 2) for t in texts], "doc string, path int, value int")
    rows = path_inventory(df, F.col("doc")).collect()
    found = {(r["path"], r["kind"]): r["n_values"] for r in rows}
    assert len(found) == len(rows)
    return found


def grown(rng, depth):
    pick = rng.randrange(8 if depth else 6)
    if pick < 6:
        return [None, True, rng.randrange(-5, 10**12), 2.5, "x", ""][pick]
    if pick == 6:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample(["a", "b", "A", "a b", 'q"t', "back\\slash", "é", "dot.ted", "0", "_1"], rng.randrange(5))
    return {key: grown(rng, depth - 1) for key in keys}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    texts = [json.dumps(grown(rng, 5), ensure_ascii=rng.random() < 0.5) for _ in range(300)]
    texts += ["", "{", "nul", None, "[]", "{}", "[[], {}, [[1]]]", "12345678901234567890123"]
    assert inventory(spark, texts) == brute(texts)


def test_mixed_kinds_and_objects_in_arrays(spark):
    texts = ['{"a":[{"b":1},{"b":"x"},{"b":null},7]}'] * 3 + ['{"a":{"b":2}}', '{"a":null}']
    assert inventory(spark, texts) == {
        ("$", "object"): 5,
        ("$.a", "array"): 3,
        ("$.a", "object"): 1,
        ("$.a", "null"): 1,
        ("$.a.b", "integer"): 1,
        ("$.a[*]", "object"): 9,
        ("$.a[*]", "integer"): 3,
        ("$.a[*].b", "integer"): 3,
        ("$.a[*].b", "text"): 3,
        ("$.a[*].b", "null"): 3,
    }


def test_deep_and_empty(spark):
    deep = "[" * 40 + "1" + "]" * 40
    assert inventory(spark, [deep])["$" + "[*]" * 40, "integer"] == 1
    assert inventory(spark, [None]) == {}
