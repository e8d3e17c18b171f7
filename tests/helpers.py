import hashlib
import random


def py_id(text, asin):
    key = " ".join((text or "").split()).lower() + "\x01" + (asin or "").strip().lower()
    return hashlib.sha1(key.encode()).hexdigest()


def row_hash(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def py_label(rating):
    return 0 if rating <= 2 else 2 if rating >= 4 else 1


REVIEW_DDL = ("seq BIGINT, text STRING, rating DOUBLE, title STRING, asin STRING,"
              " product_category STRING")


def make_reviews(n=1500, seed=3):
    """Reviews where a third are copies of one text and one category holds most rows."""
    rng = random.Random(seed)
    words = "good bad fine broken great poor okay nice slow fast".split()
    rows = []
    for seq in range(n):
        if rng.random() < 0.34:
            text, asin = rng.choice(["Hot  text of\tall", "hot text OF all "]), "A0"
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
            asin = f"A{rng.randrange(6)}"
        category = "Books" if rng.random() < 0.8 else rng.choice(["Toys", "Pets"])
        rows.append((seq, text, float(rng.randrange(1, 6)), f"t{seq % 5}", asin, category))
    return rows


def accepted(rows, blocked=(), words=0, dedup=True):
    """Brute force: rows long enough, not blocked, first arrival of their id."""
    seen, kept = set(), []
    for row in sorted(rows):
        rid = py_id(row[1], row[4])
        if len(row[1].split()) < words or rid in blocked or (dedup and rid in seen):
            continue
        seen.add(rid)
        kept.append((row, rid))
    return kept
