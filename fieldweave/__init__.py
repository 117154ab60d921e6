"""Linking column names across schemas, and preparing training corpora, as Spark jobs."""

from importlib import import_module

#: Where the public names live; each module is imported when its name is first asked for, so that
#: preparing data needs nothing that only models need.
_PLACES = {
    "MatcherConfig": "config", "ModelBundle": "operators.model", "prepare": "plans.prepare", "validate": "plans.train", "train": "plans.train", "evaluate": "plans.evaluate",
    "predict_pair": "plans.predict", "predict_pairs_csv": "plans.predict", "match_groups_csv": "plans.predict", "predict_pairs": "operators.matching", "match_groups": "operators.matching",
    "cosine_top_k": "operators.retrieval", "components": "operators.components", "synthetic_negatives": "operators.negatives", "with_normalized": "functions.text",
    "CharVocabulary": "operators.vocabulary", "CharacterVocabulary": "operators.vocabulary", "Vocabulary": "operators.vocabulary", "SiameseFieldMatcher": "operators.model", "SiameseModel": "operators.model",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(f"{__name__}.{_PLACES[name]}"), name)
    raise AttributeError(f"module {__name__} has no attribute {name}")


def __dir__() -> list[str]:
    return [*globals(), *_PLACES]
