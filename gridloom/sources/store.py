"""Files by path or address: local, or in any store that Arrow can open."""

from __future__ import annotations

import os


def _parted(path: str):
    """(store, path within it); no store for local files."""
    if path.startswith("file://"):
        return None, path[7:]
    if "://" not in path:
        return None, path
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_input(path: str):
    """A seekable file."""
    store, inner = _parted(path)
    return store.open_input_file(inner) if store else open(inner, "rb")


def open_output(path: str):
    """A file that is only ever added to; large stores take it in parts of their own choosing."""
    store, inner = _parted(path)
    if store:
        return store.open_output_stream(inner)
    os.makedirs(os.path.dirname(os.path.abspath(inner)), exist_ok=True)
    return open(inner, "wb")


def remove(path: str) -> None:
    store, inner = _parted(path)
    if store:
        from pyarrow import fs

        if store.get_file_info(inner).type != fs.FileType.NotFound:
            store.delete_file(inner)
    elif os.path.exists(inner):
        os.remove(inner)


def move(old: str, new: str) -> None:
    store, inner = _parted(old)
    if store:
        store.move(inner, _parted(new)[1])
    else:
        os.replace(inner, _parted(new)[1])


def names(folder: str) -> list[str]:
    """Names of a folder's files; none if it isn't there."""
    store, inner = _parted(folder)
    if store:
        from pyarrow import fs

        return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if i.is_file)
    return sorted(os.listdir(inner)) if os.path.isdir(inner) else []


def is_folder(path: str) -> bool:
    store, inner = _parted(path)
    if store:
        from pyarrow import fs

        return store.get_file_info(inner).type == fs.FileType.Directory
    return os.path.isdir(inner)


def joined(folder: str, name: str) -> str:
    return folder.rstrip("/") + "/" + name
