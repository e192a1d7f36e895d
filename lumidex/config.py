"""Constants and options of the index."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

SUPPORTED = (".pdf", ".docx", ".txt", ".md")
CHUNK_WORDS, CHUNK_OVERLAP = 500, 50
DIMENSIONS = 384
EXCLUDED = ("node_modules", ".git", "__pycache__", ".venv")

# Words that say nothing in a query; results depend on exactly these.
FILLERS = frozenset(
    """
    the a an is are was were be been being
    have has had do does did will would could
    should may might shall can need must
    i me my we our you your he she it
    they them their its his her
    this that these those what which who whom
    some any no not all each every both
    about from into with without for of on in
    at to by up down out off over under
    just also very really quite too so then
    here there where when how why
    find search look looking show give get
    file files document documents doc docs
    thing stuff something
    last recent recently ago yesterday today week
    month year downloaded saved wrote created made
    """.split()
)

# The score bands of the tiers and the share below which results are cut.
SUBSTRING_SCORE, ALL_WORDS_SCORE, ANY_WORD_SCORE, PER_WORD = 1.0, 0.95, 0.8, 0.1
KEYWORD_LOW, KEYWORD_HIGH, KEYWORD_STEP = 0.5, 0.85, 0.05
CUTOFF = 0.25
SNIPPET = 300


@dataclass(frozen=True)
class EngineConfig:
    """Options of a build; ``load`` takes what a JSON file says and defaults for the rest."""

    folders: tuple[str, ...] = ()
    excluded: tuple[str, ...] = EXCLUDED
    chunk_words: int = CHUNK_WORDS
    chunk_overlap: int = CHUNK_OVERLAP
    dimensions: int = DIMENSIONS
    model_path: str = ""
    top_k: int = 5
    workers: int = field(default=4)

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        try:
            with open(os.path.expanduser(path), encoding="utf-8") as f:
                said = json.load(f)
        except (OSError, ValueError):
            said = {}
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items() if k in known})

    def save(self, path: str) -> None:
        with open(os.path.expanduser(path), "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)
