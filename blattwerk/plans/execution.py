"""Plans carried out on files: renaming pairs, taking back a run.

File moves happen one by one on the driver, as each decides on what the folder
holds then; the rows to log are returned as they are written to the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path


def free_stem(folder: Path, stem: str, suffix: str) -> str:
    """``stem``, or with the first number in parentheses that no file of the folder has."""
    names = (stem if n == 1 else f"{stem} ({n})" for n in range(1, 1_000_000))
    return next(s for s in names if not (folder / f"{s}{suffix}").exists() and not (folder / f"{s}.md").exists())


def _moved(pairs: list[tuple[Path, Path]]) -> str | None:
    """Moves all pairs or none; the reason why not."""
    done: list[tuple[Path, Path]] = []
    for a, b in pairs:
        try:
            b.parent.mkdir(parents=True, exist_ok=True)
            a.rename(b)
            done.append((a, b))
        except OSError as e:
            for x, y in reversed(done):
                y.rename(x)
            return str(e)
    return None


def renamed(run: str, plan: Iterable[dict], stop: Callable[[], bool] = lambda: False) -> Iterator[dict]:
    """Renames each text and its original to a free name; yields a row of the log for each.

    ``plan`` has ``md``, ``original`` and ``neu``. A pair that isn't there any more is left
    out, one that can't be renamed stays as it was and gives a row with the reason
    in ``hinweis`` and the status FEHLER.
    """
    for entry in plan:
        if stop():
            return
        md, original = Path(entry["md"]), Path(entry["original"])
        if not (md.is_file() and original.is_file()):
            continue
        stem = free_stem(md.parent, entry["neu"], original.suffix)
        target, text = md.parent / f"{stem}{original.suffix}", md.parent / f"{stem}.md"
        why = _moved([(original, target), (md, text)])
        row = {"lauf": run, "original_name": original.name, "von_pfad": str(original)}
        if why:
            yield row | {"status": "FEHLER", "hinweis": why}
        else:
            yield row | {"status": "UMBENANNT", "neuer_name": stem, "ordner": md.parent.name, "nach_pfad": str(target), "md_pfad": str(text)}


def taken_back(steps: Iterable[dict]) -> Iterator[dict]:
    """Moves each step of an undo plan back; yields a row RÜCKGÄNGIG of the same run for each.

    ``steps`` have ``lauf``, ``von`` (where the file is), ``nach`` (where it was) and may have
    ``md``. Nothing is overwritten or deleted: a step whose file is gone or whose
    place is taken is left out; the text goes beside the file unless its place is taken.
    """
    for step in steps:
        here, there = Path(step["von"]), Path(step["nach"])
        if there.exists() or not here.exists() or _moved([(here, there)]):
            continue
        md, beside = step.get("md"), there.with_suffix(".md")
        if md and Path(md).is_file() and not beside.exists():
            _moved([(Path(md), beside)])
        yield {"lauf": step["lauf"], "status": "RÜCKGÄNGIG", "ordner": there.parent.name, "von_pfad": str(here), "nach_pfad": str(there), "md_pfad": str(beside)}
