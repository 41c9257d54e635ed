"""Signature rules of the licence scan: hand-written patterns over texts reduced to words with one space between them.

A rule is (name, label, keyword, priority, pattern). The keyword is a plain substring that any match of the pattern
holds; the pattern is only tried where the keyword is found. Priority 1 outranks 2, and so on:

1. a machine-readable tag (``spdx license identifier``),
2. a full statement ("licensed under the ... license version 2 0"),
3. a licence's name with its version, or its address,
4. a bare name or short form in a licensing phrase,
5. a general notice (copyright line, all rights reserved).
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    label: str
    keyword: str
    priority: int
    pattern: str


#: Licences by hand: label, keyword, SPDX tag as words, name pattern, bare short form or None, address as words or None.
LICENCES: tuple[tuple[str, str, str, str, str | None, str | None], ...] = (
    ("apache-2.0", "apache", "apache 2 0", r"apache (?:software )?licen[cs]e,? ?(?:version |v)?2(?: 0)?", r"apache (?:v ?)?2(?: 0)?", r"apache org licenses license 2 0"),
    ("apache-1.1", "apache", "apache 1 1", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("apache-1.0", "apache", "apache 1 0", r"apache (?:software )?licen[cs]e (?:version |v)?1 0", None, None),
    ("mit", "mit", "mit", r"(?:mit|expat) licen[cs]e", r"mit(?: x11)?", r"opensource org licenses mit"),
    ("mit-0", "mit", "mit 0", r"mit no attribution(?: licen[cs]e)?", None, None),
    ("bsd-2-clause", "bsd", "bsd 2 clause", r"(?:simplified|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[cs]e", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)", r"opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", r"(?:new|modified|revised|bsd 3 clause|3 clause bsd|three clause bsd)(?: bsd)? licen[cs]e", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", r"opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e", r"(?:bsd 4 clause|4 clause bsd|original bsd)", None),
    ("0bsd", "bsd", "0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd) licen[cs]e", r"(?:0bsd|zero clause bsd)", None),
    ("gpl-1.0", "gnu", "gpl 1 0", r"gnu general public licen[cs]e (?:version |v)1", None, None),
    ("gpl-2.0", "gnu", "gpl 2 0", r"gnu general public licen[cs]e (?:version |v)2", None, r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-3.0", "gnu", "gpl 3 0", r"gnu general public licen[cs]e (?:version |v)3", None, r"gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "gnu", "lgpl 2 0", r"gnu library general public licen[cs]e(?: (?:version |v)2)?", None, None),
    ("lgpl-2.1", "gnu", "lgpl 2 1", r"gnu lesser general public licen[cs]e (?:version |v)2 1", None, r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-3.0", "gnu", "lgpl 3 0", r"gnu lesser general public licen[cs]e (?:version |v)3", None, r"gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "affero", "agpl 3 0", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v)3)?", None, r"gnu org licenses agpl 3 0"),
    ("gfdl-1.3", "gnu", "gfdl 1 3", r"gnu free documentation licen[cs]e(?: (?:version |v)1 [123])?", None, r"gnu org licenses fdl"),
    ("mpl-1.1", "mozilla", "mpl 1 1", r"mozilla public licen[cs]e (?:version |v)?1 1", None, r"mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", r"mozilla public licen[cs]e(?: (?:version |v)?2 0)?", None, r"mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", "epl 1 0", r"eclipse public licen[cs]e (?:version |v)?1 0", None, r"eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "epl 2 0", r"eclipse public licen[cs]e(?: (?:version |v)?2 0)?", None, r"eclipse org legal epl 2 0"),
    ("cddl-1.0", "common development", "cddl 1 0", r"common development and distribution licen[cs]e(?: (?:version |v)?1 [01])?", None, None),
    ("cpl-1.0", "common public", "cpl 1 0", r"common public licen[cs]e(?: (?:version |v)?1 0)?", None, None),
    ("eupl-1.2", "european union", "eupl 1 2", r"european union public licen[cs]e(?: (?:version |v)?1 [12])?", None, None),
    ("isc", "isc", "isc", r"isc licen[cs]e", None, r"opensource org licenses isc"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", None, None),
    ("libpng", "libpng", "libpng", r"libpng licen[cs]e", None, None),
    ("boost-1.0", "boost", "bsl 1 0", r"boost software licen[cs]e(?: (?:version |v)?1 0)?", None, r"boost org license 1 0"),
    ("unlicense", "unlicense", "unlicense", r"(?:the )?unlicense", None, r"unlicense org"),
    ("wtfpl", "wtf", "wtfpl", r"(?:do what the fuck you want to public licen[cs]e|wtfpl)", None, None),
    ("artistic-2.0", "artistic", "artistic 2 0", r"artistic licen[cs]e(?: (?:version |v)?2 0)?", None, None),
    ("artistic-1.0", "artistic", "artistic 1 0", r"artistic licen[cs]e (?:version |v)?1 0", None, None),
    ("python-2.0", "python", "python 2 0", r"python software foundation licen[cs]e(?: (?:version |v)?2(?: 0)?)?", None, None),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[cs]e", None, None),
    ("openssl", "openssl", "openssl", r"openssl licen[cs]e", None, None),
    ("php-3.01", "php", "php 3 01", r"php licen[cs]e(?: (?:version |v)?3 0(?:1)?)?", None, None),
    ("ruby", "ruby", "ruby", r"ruby licen[cs]e", None, None),
    ("vim", "vim", "vim", r"vim licen[cs]e", None, None),
    ("tcl", "tcl", "tcl", r"tcl tk licen[cs]e", None, None),
    ("ncsa", "illinois", "ncsa", r"university of illinois(?: ncsa)? open source licen[cs]e", None, None),
    ("w3c", "w3c", "w3c", r"w3c software(?: notice and)? licen[cs]e", None, None),
    ("ofl-1.1", "open font", "ofl 1 1", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 [01])?", None, r"scripts sil org ofl"),
    ("ms-pl", "microsoft public", "ms pl", r"microsoft public licen[cs]e", None, None),
    ("ms-rl", "microsoft reciprocal", "ms rl", r"microsoft reciprocal licen[cs]e", None, None),
    ("upl-1.0", "universal permissive", "upl 1 0", r"universal permissive licen[cs]e(?: (?:version |v)?1 0)?", None, None),
    ("bsl-1.1", "business source", "busl 1 1", r"business source licen[cs]e(?: (?:version |v)?1 1)?", None, None),
    ("sspl-1.0", "server side", "sspl 1 0", r"server side public licen[cs]e(?: (?:version |v)?1)?", None, None),
    ("elastic-2.0", "elastic", "elastic 2 0", r"elastic licen[cs]e(?: (?:version |v)?2 0)?", None, None),
    ("odbl-1.0", "open database", "odbl 1 0", r"open (?:data commons )?(?:open )?database licen[cs]e(?: (?:version |v)?1 0)?", None, r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", "open data commons", "odc by 1 0", r"open data commons attribution licen[cs]e", None, r"opendatacommons org licenses by"),
    ("pddl-1.0", "public domain dedication", "pddl 1 0", r"(?:open data commons )?public domain dedication and licen[cs]e", None, None),
    ("cc0-1.0", "cc0", "cc0 1 0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", None, r"creativecommons org publicdomain zero 1 0"),
    ("ogl-uk-3.0", "open government", "ogl uk 3 0", r"open government licen[cs]e(?: (?:version |v)?[123] 0)?", None, None),
    ("etalab-2.0", "etalab", "etalab 2 0", r"(?:licence ouverte )?etalab(?: (?:version |v)?[12] 0)?", None, None),
    ("openrail-m", "openrail", "openrail m", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", None, None),
    ("cecill-2.1", "cecill", "cecill 2 1", r"cecill(?: (?:free software )?licen[cs]e)?(?: (?:version |v)?2 [01])?", None, None),
    ("beerware", "beer", "beerware", r"beer ?ware licen[cs]e", None, None),
    ("x11", "x11", "x11", r"x11 licen[cs]e", None, None),
    ("afl-3.0", "academic free", "afl 3 0", r"academic free licen[cs]e(?: (?:version |v)?3 0)?", None, None),
    ("osl-3.0", "open software", "osl 3 0", r"open software licen[cs]e(?: (?:version |v)?3 0)?", None, None),
    ("qpl-1.0", "q public", "qpl 1 0", r"q public licen[cs]e", None, None),
    ("lppl-1.3c", "latex project", "lppl 1 3c", r"latex project public licen[cs]e", None, None),
)

#: Creative Commons variants: label part and its words.
CC_KINDS: tuple[tuple[str, str], ...] = (("by", "by"), ("by-sa", "by sa"), ("by-nc", "by nc"), ("by-nd", "by nd"), ("by-nc-sa", "by nc sa"), ("by-nc-nd", "by nc nd"))
CC_NAMES: dict[str, str] = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nc": "attribution non ?commercial",
    "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
CC_VERSIONS: tuple[str, ...] = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Texts of licences and general notices: name, label, keyword, priority, pattern.
NOTICES: tuple[Rule, ...] = (
    Rule("mit-grant", "mit", "permission is hereby granted", 2, r"permission is hereby granted free of charge to any person obtaining a copy"),
    Rule("isc-grant", "isc", "permission to use", 2, r"permission to use copy modify and or distribute this software for any purpose"),
    Rule("bsd-grant", "bsd", "redistribution and use", 2, r"redistribution and use in source and binary forms with or without modification are permitted"),
    Rule("bsd-3-endorse", "bsd-3-clause", "endorse or promote", 2, r"may be used to endorse or promote products derived from this software"),
    Rule("apache-grant", "apache-2.0", "you may not use this file", 2, r"you may not use this file except in compliance with the license"),
    Rule("gpl-grant", "gpl", "redistribute it and or modify", 2, r"redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    Rule("lgpl-grant", "lgpl", "redistribute it and or modify", 2, r"redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    Rule("mpl-grant", "mpl-2.0", "this source code form", 2, r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    Rule("unlicense-grant", "unlicense", "public domain", 2, r"free and unencumbered software released into the public domain"),
    Rule("zlib-grant", "zlib", "as is", 2, r"this software is provided as is without any express or implied warranty"),
    Rule("boost-grant", "boost-1.0", "permission is hereby granted", 2, r"permission is hereby granted free of charge to any person or organization obtaining"),
    Rule("gpl-name", "gpl", "general public", 4, r"(?:gnu )?general public licen[cs]e"),
    Rule("lgpl-name", "lgpl", "lesser general public", 4, r"(?:gnu )?lesser general public licen[cs]e"),
    Rule("apache-name", "apache", "apache", 4, r"apache licen[cs]e"),
    Rule("bsd-name", "bsd", "bsd", 4, r"bsd(?: style)? licen[cs]e"),
    Rule("cc-name", "cc", "creative commons", 4, r"creative commons(?: public)? licen[cs]e"),
    Rule("public-domain", "public-domain", "public domain", 4, r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    Rule("domain-is", "public-domain", "public domain", 4, r"(?:is|are) in the public domain"),
    Rule("all-rights", "proprietary", "rights reserved", 5, r"all rights reserved"),
    Rule("rights-fr", "proprietary", "droits", 5, r"tous droits réservés"),
    Rule("rights-de", "proprietary", "rechte", 5, r"alle rechte vorbehalten"),
    Rule("rights-es", "proprietary", "derechos", 5, r"todos los derechos reservados"),
    Rule("no-reproduce", "proprietary", "reproduc", 5, r"(?:may not|must not|no part of this [0-9a-z]+ may) be reproduced"),
    Rule("confidential", "proprietary", "confidential", 5, r"(?:proprietary and confidential|confidential and proprietary)"),
    Rule("permission-of", "proprietary", "permission", 5, r"without (?:the )?(?:prior |express )*(?:written )?permission of"),
    Rule("copyright-line", "copyright", "copyright", 5, r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    Rule("copyright-by", "copyright", "copyright", 5, r"copyright (?:is )?(?:held|owned) by"),
)

_UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|made available) under (?:the (?:terms of the )?)?"
_TERMS = r"(?:subject to|under|according to) the terms (?:and conditions )?of the "


def rules() -> tuple[Rule, ...]:
    """All rules in order of priority; several hundred, written out from the tables above."""
    out = list(NOTICES)
    for label, key, tag, name, short, url in LICENCES:
        out.append(Rule(f"{label}-tag", label, "spdx", 1, f"spdx licen[cs]e identifier {tag}(?: only| or later)?"))
        out.append(Rule(f"{label}-under", label, key, 2, f"{_UNDER}{name}"))
        out.append(Rule(f"{label}-terms", label, key, 2, f"{_TERMS}{name}"))
        out.append(Rule(f"{label}-name", label, key, 3, name))
        if short:
            out.append(Rule(f"{label}-short", label, key, 4, f"(?:{_UNDER}|licen[cs]e ){short}"))
        if url:
            out.append(Rule(f"{label}-url", label, url.split(" ")[0], 3, url))
    for kind, said in CC_KINDS:
        for version in CC_VERSIONS:
            v, label = version.replace(".", " "), f"cc-{kind}-{version}"
            out.append(Rule(f"{label}-tag", label, "spdx", 1, f"spdx licen[cs]e identifier cc {said} {v}"))
            out.append(Rule(f"{label}-under", label, "cc by", 2, f"{_UNDER}cc {said} {v}"))
            out.append(Rule(f"{label}-code", label, "cc by", 3, f"cc {said} {v}"))
            out.append(Rule(f"{label}-name", label, "creative commons", 3, f"creative commons {CC_NAMES[kind]} {v}(?: international| unported| generic)?(?: licen[cs]e)?"))
            out.append(Rule(f"{label}-url", label, "creativecommons", 3, f"creativecommons org licenses {said} {v}"))
    return tuple(sorted(out, key=lambda r: (r.priority, r.name)))
