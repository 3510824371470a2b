"""Command line: what a batch run asks for, where its files go, and a short description of the engine.

    python -m cuegrid.cli dub chat.wav --style duo --speakers 2 de fr
    python -m cuegrid.cli info
"""

from __future__ import annotations

import argparse
import shutil
from dataclasses import dataclass
from pathlib import Path

from cuegrid.functions.languages import DEFAULT_TARGETS
from cuegrid.settings import Settings

VERSION = "2.0"


@dataclass(frozen=True)
class Run:
    """One medium, its style, the number of voices (None: one voice, 0: as many as are heard) and the languages."""

    source: str
    style: str = "solo"
    speakers: int | None = None
    targets: tuple[str, ...] = tuple(DEFAULT_TARGETS)
    srt_only: bool = False


@dataclass(frozen=True)
class Layout:
    """The folders of a run, made when they are asked for."""

    root: str

    def folder(self, name: str) -> Path:
        path = Path(self.root) / name
        path.mkdir(parents=True, exist_ok=True)
        return path

    @property
    def downloads(self) -> Path:
        return self.folder("downloads")

    @property
    def work(self) -> Path:
        return self.folder("work")

    @property
    def output(self) -> Path:
        return self.folder("output")


def missing_tools(names: tuple[str, ...] = ("ffmpeg", "ffprobe")) -> list[str]:
    """External tools that are not on the path."""
    return [name for name in names if shutil.which(name) is None]


def lip_sync_errors(folder: str | None, checkpoint: str | None) -> list[str]:
    """Why lip synchronisation cannot run; nothing if it can."""
    if not folder or not checkpoint:
        return ["lip synchronisation needs the folder of its tool and a checkpoint"]
    found = []
    if not (Path(folder) / "inference.py").exists():
        found.append(f"{folder}/inference.py is missing")
    if not Path(checkpoint).exists():
        found.append(f"checkpoint {checkpoint} is missing")
    return found


def parse(arguments: list[str]) -> Run | None:
    """The medium first, then flags in any order, then languages; None for ``info``."""
    parser = argparse.ArgumentParser(prog="cuegrid", description="Plan dubs and subtitles.")
    commands = parser.add_subparsers(dest="command", required=True)
    dub = commands.add_parser("dub")
    dub.add_argument("source")
    dub.add_argument("--style", default=Run.style)
    dub.add_argument("--speakers", type=int)
    dub.add_argument("--srt-only", action="store_true")
    dub.add_argument("targets", nargs="*")
    commands.add_parser("info")
    found = dub.parse_intermixed_args(arguments[1:]) if arguments[:1] == ["dub"] else parser.parse_args(arguments)
    if getattr(found, "command", "dub") == "info":
        return None
    return Run(found.source, found.style, found.speakers, tuple(found.targets) or Run.targets, found.srt_only)


def info(settings: Settings = Settings(device="auto")) -> str:
    return f"cuegrid {VERSION}\ndevice: {settings.resolved_device}"


def main(arguments: list[str] | None = None) -> None:
    import sys

    run = parse(sys.argv[1:] if arguments is None else arguments)
    print(info() if run is None else run)


if __name__ == "__main__":
    main()
