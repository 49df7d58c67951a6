"""What a Python worker remembers of a step goes when it serves another."""

import weakref

import numpy as np

from tessera.llm import common, pieces, toxicity


def test_a_worker_holds_the_memory_of_one_step():
    common.memory_of("another")
    held = weakref.ref(pieces.encoder(pieces.default_model()))
    assert pieces.encoder(pieces.default_model()) is held()
    judge = toxicity.Judge(toxicity.CharacterModel({}), np.full(toxicity.SLOTS, -1, np.int32), np.zeros(1))
    judge.start()
    assert held() is None
    assert judge.score("an idiot") == 0.5
    judge.stop()
    assert not hasattr(judge, "features")
