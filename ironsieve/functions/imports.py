"""Import specifiers of source files, and what they say about a file and a project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: categories of imported packages
CATEGORIES = {
    "auth": r"^(?:passport|@clerk/|next-auth|@auth/|lucia|@lucia-auth/|better-auth|iron-session|express-jwt|jsonwebtoken|jose|@supabase/auth-helpers|@kinde-oss/|@auth0/|firebase-admin/auth|@firebase/auth)",
    "stripe": r"^stripe$",
    "sanitization": r"^(?:dompurify|isomorphic-dompurify|sanitize-html|xss|xss-filters|@types/dompurify|he|html-entities|escape-html|validator)",
    "validation": r"^(?:zod|joi|yup|class-validator|express-validator|superstruct|valibot|io-ts|runtypes|@sinclair/typebox|ajv|ow)",
    "orm": r"^(?:@prisma/client|drizzle-orm|sequelize|typeorm|knex|mongoose|@mikro-orm/|objection|bookshelf|kysely|@neondatabase/serverless)",
    "crypto": r"^(?:bcrypt|bcryptjs|argon2|crypto|node:crypto|scrypt|@node-rs/bcrypt|@node-rs/argon2)",
    "rate_limit": r"^(?:express-rate-limit|rate-limiter-flexible|@nestjs/throttler|bottleneck|p-throttle|limiter|@upstash/ratelimit)",
    "csrf": r"^(?:csurf|csrf|csrf-csrf|lusca|@fastify/csrf-protection|tiny-csrf)",
    "helmet": r"^helmet$",
}
# fixed values: ways to import a module
FORMS = (
    r"(?:^|\n)\s*import\s+(?:(?:[\w*{}\s,]+)\s+from\s+)?['\"]([^'\"]+)['\"]",
    r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
)
# fixed values: what a project is built with, by its dependencies; the first name that fits counts
STACK = {
    "framework": (("nextjs", ("next",)), ("fastify", ("fastify",)), ("hono", ("hono",)), ("express", ("express",)), ("koa", ("koa",))),
    "auth": (
        ("clerk", ("@clerk/nextjs", "@clerk/clerk-react", "@clerk/clerk-js")),
        ("next-auth", ("next-auth", "@auth/core")),
        ("passport", ("passport",)),
        ("lucia", ("lucia", "@lucia-auth/adapter-prisma", "lucia-auth")),
    ),
    "orm": (
        ("prisma", ("@prisma/client", "prisma")),
        ("drizzle", ("drizzle-orm",)),
        ("sequelize", ("sequelize",)),
        ("typeorm", ("typeorm",)),
        ("knex", ("knex",)),
    ),
}
PYTHON_FRAMEWORKS = ("django", "fastapi", "flask")
FRAMEWORKS = ("next", "express", "fastify", "hono", "koa", "@nestjs/core", "react", "vue", "svelte")


def specifiers(text: Column) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(f), F.lit(1)) for f in FORMS])


def _named(found: Column, pattern: str) -> Column:
    return F.exists(found, lambda s: F.rlike(s, F.lit(pattern)))


def categories(text: Column) -> Column:
    """The categories of a file's imports."""
    found = specifiers(text)
    return F.array_compact(F.array(*[F.when(_named(found, p), F.lit(c)) for c, p in CATEGORIES.items()]))


def category_flags(text: Column) -> list[Column]:
    """has_<category> of a file's imports."""
    return [_named(specifiers(text), p).alias(f"has_{c}") for c, p in CATEGORIES.items()]


def framework(dependencies: Column) -> Column:
    """The first framework in order of precedence that the dependencies name, or null."""
    return F.coalesce(*[F.when(F.map_contains_key(dependencies, f), F.lit(f)) for f in FRAMEWORKS])


def stack(dependencies: Column) -> list[Column]:
    """framework, auth and orm of a project's dependencies (a map by name), each null if none is known."""

    def first(kinds) -> Column:
        names = F.map_keys(dependencies)
        return F.coalesce(*[F.when(F.arrays_overlap(names, F.array(*map(F.lit, own))), F.lit(kind)) for kind, own in kinds])

    return [first(kinds).alias(what) for what, kinds in STACK.items()]


def python_framework(manifest: Column) -> Column:
    """The framework that a Python manifest's text names."""
    low = F.lower(manifest)
    return F.coalesce(*[F.when(F.contains(low, F.lit(f)), F.lit(f)) for f in PYTHON_FRAMEWORKS])
