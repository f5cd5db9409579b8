"""Local clones of repositories, by the git program on the driver."""

from __future__ import annotations

import os
import shutil
import subprocess


class CloneError(RuntimeError):
    pass


def _git(*args: str, cwd: str | None = None, timeout: float = 300) -> str:
    env = os.environ | {"GIT_TERMINAL_PROMPT": "0"}
    try:
        done = subprocess.run(["git", *args], cwd=cwd, env=env, capture_output=True, text=True, timeout=timeout, check=True)
    except subprocess.CalledProcessError as e:
        raise CloneError(e.stderr.strip() or str(e)) from e
    except (subprocess.TimeoutExpired, OSError) as e:
        raise CloneError(str(e)) from e
    return done.stdout.strip()


def is_clone(path: str) -> bool:
    """Whether the folder is the root of a repository with a commit."""
    if not os.path.isdir(os.path.join(path, ".git")):
        return False
    try:
        _git("rev-parse", "--verify", "HEAD", cwd=path)
        return True
    except CloneError:
        return False


def clone(address: str, folder: str, name: str, update: bool = False, timeout: float = 300) -> str:
    """The path of a shallow clone of one branch; a valid one is used again, a failed one leaves nothing behind.

    Blocks the driver for at most ``timeout`` seconds.
    """
    if address.startswith("-") or os.path.basename(name) != name or name in ("", ".", ".."):
        raise ValueError("not an address or name of a repository")
    path = os.path.join(folder, name)
    if is_clone(path):
        if update:
            pull(path, timeout)
        return path
    shutil.rmtree(path, ignore_errors=True)
    os.makedirs(folder, exist_ok=True)
    try:
        _git("clone", "--quiet", "--depth", "1", "--single-branch", "--", address, path, timeout=timeout)
    except CloneError:
        shutil.rmtree(path, ignore_errors=True)
        raise
    return path


def pull(path: str, timeout: float = 300) -> bool:
    """Bring a clone to the newest commit of its branch; whether it moved."""
    before = _git("rev-parse", "HEAD", cwd=path)
    _git("fetch", "--quiet", "--depth", "1", "origin", "HEAD", cwd=path, timeout=timeout)
    _git("reset", "--quiet", "--hard", "FETCH_HEAD", cwd=path)
    return _git("rev-parse", "HEAD", cwd=path) != before


def head(path: str) -> dict[str, str]:
    """Commit, author, time and first line of the message of the present commit."""
    commit, author, time, subject = _git("log", "-1", "--format=%H%x00%an%x00%cI%x00%s", cwd=path).split("\0")
    return {"commit": commit, "author": author, "committed_at": time, "subject": subject}


def clones(folder: str) -> list[str]:
    """Names of the valid clones in a folder, in order."""
    return sorted(n for n in (os.listdir(folder) if os.path.isdir(folder) else []) if is_clone(os.path.join(folder, n)))


def remove(folder: str, name: str) -> bool:
    """Delete one clone; whether there was one."""
    path = os.path.join(folder, name)
    if os.path.basename(name) != name or not os.path.isdir(os.path.join(path, ".git")):
        return False
    shutil.rmtree(path)
    return True
