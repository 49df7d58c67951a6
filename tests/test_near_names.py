"""Names that are all near each other: resolved as turn by turn, tile by tile, without a row for each pair."""

import glob
import random

import pytest

from tessera.operators import resolution, search
from tessera.providers import LetterEmbedder
from tessera.stages import Stages


@pytest.mark.parametrize("seed", [1, 2])
def test_near_names_grow_with_the_names(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(search, "TILE_ROWS", 40)
    monkeypatch.setattr(search, "TILE_QUERIES", 30)
    names = sorted({"".join(rng.sample("aabbccdefgh", 8)) for _ in range(160)} | {f"xyz-{k} of {'w' * (k % 7)}" for k in range(20)})
    said = [(g, f"e{g}{k}", name, name, 0, False) for g in ("g", "h") for k in range(120) for name in rng.sample(names, 3)]
    mentions = spark.createDataFrame(said, "group_id string, episode_uuid string, key string, name string, pos long, is_speaker boolean")
    episodes = spark.createDataFrame([(g, f"e{g}{k}", k // 2, f"s{k:03d}") for g in ("g", "h") for k in range(120)], "group_id string, uuid string, seq long, source_id string")
    known = spark.createDataFrame([("g", f"k{k}", n) for k, n in enumerate(names[::40])], "group_id string, uuid string, name string")
    stages, match = Stages(spark, "near-names"), (0.92, 0.6)
    found = resolution.resolve_in_order(mentions, episodes, known, LetterEmbedder(), match, stages)
    want = resolution.fold_entities(mentions, episodes, known, LetterEmbedder(), match)
    rows = lambda df: sorted((r["group_id"], r["episode_uuid"], r["key"], r["uuid"]) for r in df.collect())
    assert rows(found) == rows(want)
    pairs = sum(spark.read.parquet(p).count() for p in glob.glob(f"{stages.folder.removeprefix('file://')}/near*") if not p.endswith("names-index"))
    assert pairs < 12 * len(names)
