"""Path guard: lexical normalisation and ordered classes, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilake.functions.columns import let

#: File names of each class.
DOTENV = (".env", ".envrc", ".envfile")
SSH_KEYS = ("id_rsa", "id_ed25519", "id_dsa", "id_ecdsa", "id_ed25519_sk", "id_ecdsa_sk", "id_dsa_sk", "id_rsa_sk")
CREDENTIALS = (".netrc", "_netrc", ".pgpass", ".npmrc", ".dockercfg")
PROFILES = (".bashrc", ".bash_profile", ".bash_login", ".bash_logout", ".profile", ".zshrc", ".zprofile", ".zshenv", ".zlogin", ".zlogout", ".cshrc", ".tcshrc", ".fishrc", "config.fish")


def cleaned(path: Column, home: Column) -> Column:
    """Home expanded, backslashes turned, lower case, `.` and `..` resolved as far as the text tells."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    for prefix in (r"^~(?=/|\z)", r"^\$HOME(?=/|\z)", r"^\$\{HOME\}(?=/|\z)"):
        p = F.when(p.rlike(prefix), F.concat(home, F.regexp_replace(p, prefix, ""))).otherwise(p)
    p = F.lower(p)
    rooted = p.startswith("/")

    def step(held: Column, part: Column) -> Column:
        up = (F.size(held) > 0) & (F.element_at(held, -1) != "..")
        return (
            F.when(part.isin("", "."), held)
            .when((part == "..") & up, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
            .when((part == "..") & rooted, held)
            .otherwise(F.concat(held, F.array(part)))
        )

    joined = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).otherwise(joined)


def _ssh(norm: Column) -> Column:
    return F.array_contains(F.split(norm, "/"), ".ssh")


def _etc(norm: Column) -> Column:
    return norm.rlike(r"^(?:/|(?:\.\./)*)(?:private/)?etc(?:/|\z)")


def secret_read(norm: Column) -> Column:
    """Why reading is refused, or null."""
    file = F.substring_index(norm, "/", -1)
    return (
        F.when(_ssh(norm), "path under ~/.ssh")
        .when(_etc(norm), "system path under /etc")
        .when(file.isin(*DOTENV) | file.rlike(r"^\.env[._-]"), "dotenv file")
        .when(file.endswith(".pem") | file.endswith(".key"), "key material (.pem/.key)")
        .when(file.isin(*SSH_KEYS), "ssh private key")
        .when(F.contains(file, F.lit("credentials")) | file.isin(*CREDENTIALS), "credentials file")
    )


def sensitive_write(norm: Column) -> Column:
    return F.when(_ssh(norm), "path under ~/.ssh").when(_etc(norm), "system path under /etc").when(F.substring_index(norm, "/", -1).isin(*PROFILES), "shell profile file")


def refused(path: Column, write: Column, home: Column) -> Column:
    """The reason of a block, or null; the path is cleaned once for all classes."""
    return let(cleaned(path, home), lambda norm: F.coalesce(F.when(write, sensitive_write(norm)), secret_read(norm)))
