"""A made-up project: classes in packages, chains of bounded depth, some short names; every reference resolves."""

from __future__ import annotations

import random
from collections.abc import Iterator


def project(classes: int, depth: int = 8, obfuscated: float = 0.5, packages: int = 50, interfaces: int = 20, seed: int = 11) -> Iterator[tuple[str, str]]:
    """(path, content) of each file; the same for the same arguments."""
    r = random.Random(seed)
    faces = [(f"app.p{r.randrange(packages)}", f"Face{i}") for i in range(min(interfaces, classes))]
    for package, name in faces:
        yield f"{package.replace('.', '/')}/{name}.java", f"package {package};\npublic interface {name} {{ void go(); }}\n"
    made: list[tuple[str, str, int]] = []
    for i in range(classes - len(faces)):
        package = f"app.p{r.randrange(packages)}"
        name = f"a{i:x}" if r.random() < obfuscated else f"Type{i}"
        over = r.choice(made) if made and r.random() < 0.8 else None
        level = over[2] + 1 if over else 1
        if level > depth:
            over, level = None, 1
        head, imports = "", ""
        if over:
            head, imports = f" extends {over[1]}", f"import {over[0]}.{over[1]};\n"
        if faces and r.random() < 0.3:
            face = r.choice(faces)
            head, imports = f"{head} implements {face[1]}", f"{imports}import {face[0]}.{face[1]};\n"
        made.append((package, name, level))
        yield f"{package.replace('.', '/')}/{name}.java", f"package {package};\n{imports}public class {name}{head} {{\n  public void go() {{ }}\n}}\n"
