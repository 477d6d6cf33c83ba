"""Compares settings of the toxicity model within the rows that may be learned from.

    python -m civicflow.llm.choose_toxicity FOLDER [PER_CLASS]

Held-out rows (crc32 of the id modulo 3 equal to 1) are left out by ``labelled_sample`` before
anything is looked at. Prints one line for each setting; nothing is written.
"""

from __future__ import annotations

import sys

from civicflow.llm.base import documents, labels
from civicflow.llm.toxicity import Settings, compare, labelled_sample
from civicflow.session import local_session

CHOICES = [
    Settings(),
    Settings(repeats=1),
    Settings(window=12, stride=6),
    Settings(window=24, stride=12),
    Settings(padded=6),
    Settings(padded=16),
    Settings(rounds=2),
    Settings(work=150_000),
]


def main(folder: str, per_class: int = 1200) -> None:
    spark = local_session()
    rows = labelled_sample(documents(spark, folder), labels(spark, folder), "toxic", per_class, 10, 50_000).toArrow().sort_by([("doc_id", "ascending")])
    for settings in CHOICES:
        print(*compare(rows["text"].to_pylist(), rows["label"].to_numpy(), [settings]), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
