"""Texts that depend on a number."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def story(seed: int, n: int) -> str:
    """n words that depend on the seed, in lines."""
    out, x = [], seed * 7919 + 13
    for k in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"{WORDS[x % 20]}{x // 977 % 50}" + (".\n" if k % 12 == 11 else ""))
    return " ".join(out)
