"""Last and best state of a run in a shared folder, so that a run that died can be taken up again.

A state is a folder of files; it counts only if STATE is among them, which is copied last, so an interrupted
copy is no state. ``push`` keeps the newest state and, where it is the best so far, that as well; ``clear``
removes both once the run is finished.
"""

from __future__ import annotations

import os
import shutil

KINDS = ("last", "best")
STATE = "trainer_state.json"


def path_of(run: str, kind: str = "last") -> str:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {KINDS}")
    return f"{run.strip('/')}/{kind}-checkpoint"


def push(folder: str, root: str, run: str, best: bool = False) -> None:
    """Copies a state to the run's last state and, if best, to its best one; what was there is replaced."""
    for kind in KINDS if best else KINDS[:1]:
        at = os.path.join(root, path_of(run, kind))
        fresh = at + ".new"
        shutil.rmtree(fresh, ignore_errors=True)
        shutil.copytree(folder, fresh, ignore=shutil.ignore_patterns(STATE))
        shutil.copy2(os.path.join(folder, STATE), fresh)
        shutil.rmtree(at, ignore_errors=True)
        os.replace(fresh, at)


def resume(root: str, run: str, kind: str = "last") -> str | None:
    """The folder of a whole state, or None."""
    at = os.path.join(root, path_of(run, kind))
    return at if os.path.isfile(os.path.join(at, STATE)) else None


def clear(root: str, run: str) -> None:
    for kind in KINDS:
        shutil.rmtree(os.path.join(root, path_of(run, kind)), ignore_errors=True)
