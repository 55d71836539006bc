"""Small texts with every awkward case."""


def sentence(seed, n):
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join(chr(97 + (x >> s) % 26) for s in (3, 7, 11, 15))[: 2 + x % 3] + "ou"[x % 2])
    return " ".join(out)


def texts():
    a, b = sentence(1, 120), sentence(2, 90)
    shared = sentence(3, 60)
    near = a.split()
    near[60] = "changed"
    return [
        None, "", " \t\n", "word", "two words", a, a, " ".join(near), b + " " + shared, shared + "\n" + sentence(4, 50), sentence(5, 34), sentence(6, 35), sentence(6, 35),
        "aaaa " * 200, "é" * 60 + " ünïcode ß " + "é" * 60, sentence(7, 3000) + " " + shared, "Mail me: jo.e+x@mail.example.com, +1 (743) 555-3824 or 10.0.0.255 and 10.0.0.256.",
        "card 4111 1111 1111 1111 and 4111111111111112; token = \"0123456789abcdef0123456789abcdef\"", "x <|endoftext|> Y's 12 Σς", "0" * 3000 + "@", "a@b.c_d@e.f 1.2.3.4.5.6.7.8",
        "Released under the MIT License.\n" + sentence(8, 30), "\n".join([sentence(9, 12)] * 8), "###&&&" * 40, "\u0000   \u0085 nul",
    ]
