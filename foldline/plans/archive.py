"""Structure archives on the driver: download, safe extraction, files named by id."""

from __future__ import annotations

import os
import shutil
import tarfile
import urllib.request


def download(urls: list[str], target: str, force: bool = False) -> str:
    """The first url that works, by way of a temporary name; an existing target is kept unless force."""
    if os.path.exists(target) and not force:
        return target
    errors = []
    for url in urls:
        try:
            with urllib.request.urlopen(url, timeout=60) as source, open(f"{target}.part", "wb") as f:
                shutil.copyfileobj(source, f, 1 << 20)
            os.replace(f"{target}.part", target)
            return target
        except OSError as e:
            errors.append(f"{url}: {e}")
    raise OSError("; ".join(errors) or "no urls")


def extract(archive: str, folder: str) -> None:
    """Extracts once (a marker tells); a member that would land outside folder is an error."""
    marker, root = f"{folder}/.extracted", os.path.realpath(folder)
    if os.path.exists(marker):
        return
    os.makedirs(folder, exist_ok=True)
    with tarfile.open(archive) as tar:
        for member in tar.getmembers():
            if os.path.commonpath([root, os.path.realpath(f"{folder}/{member.name}")]) != root:
                raise ValueError(f"{member.name} leaves {folder}")
        tar.extractall(folder, filter="data")
    open(marker, "w").close()


def sid_of(path: str) -> str:
    name = os.path.basename(path)
    return name.removesuffix(".pdb").removesuffix(".ent")


def wrangle(source: str, folder: str, mode: str = "copy") -> dict[str, str]:
    """Places structure files below source into folder by id; returns sid -> original path. An id twice, or no file, is an error."""
    place = {"copy": shutil.copyfile, "symlink": lambda a, b: os.symlink(os.path.abspath(a), b), "hardlink": os.link}
    if mode not in place:
        raise ValueError(f"mode must be one of {', '.join(place)}")
    found: dict[str, str] = {}
    for at, _, names in os.walk(source):
        for name in names:
            if not name.startswith(".") and (name.startswith("d") or name.endswith((".pdb", ".ent"))):
                if (sid := sid_of(name)) in found:
                    raise ValueError(f"{sid}: {found[sid]} and {at}/{name}")
                found[sid] = f"{at}/{name}"
    if not found:
        raise ValueError(f"no structure files below {source}")
    os.makedirs(folder, exist_ok=True)
    for sid, path in sorted(found.items()):
        place[mode](path, f"{folder}/{sid}")
    return dict(sorted(found.items()))
