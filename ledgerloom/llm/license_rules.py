"""Hand-written licence signatures over normalised words (lower case, single spaces, punctuation gone).

``LICENSES`` has per line: label; words to prefer as gates; signatures, strongest first. Each signature has its own
gates, words of which every text that it matches holds one.
A signature's priority is 3 for its licence's identifier tag, 2 for the first signature and 1 for the others.
"""

from __future__ import annotations

import re
from typing import NamedTuple

LICENSES = r"""
mit; license licensed expat permission; mit license; license mit; licensed under (the terms of )?(the )?mit; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation; expat license
mit-0; mit0 attribution; mit no attribution; mit 0 license
apache; apache; apache (software )?license; licensed under (the )?apache; apache org licenses; license apache
apache-2.0; apache; apache (software )?license (version |v)?2( 0)?; apache 2 0; apache org licenses license 2 0; asl 2 0
apache-1.1; apache; apache (software )?license (version |v)?1 1; apache 1 1; this product includes software developed by the apache software foundation
gpl; gnu gpl general; general public license; gnu gpl; licensed under (the )?gpl; gpl license
gpl-2.0; gpl general gplv2 gpl2; general public license (as published by the free software foundation )?(version |v)2( 0)?; gpl ?v?2( 0)?; gnu general public license 2( 0)?; licenses gpl 2 0; either version 2 of the license or at your option any later version
gpl-3.0; gpl general gplv3 gpl3; general public license (as published by the free software foundation )?(version |v)3( 0)?; gpl ?v?3( 0)?; licenses gpl 3 0; either version 3 of the license or at your option any later version
lgpl; lesser library lgpl; (gnu )?(lesser|library) general public license; gnu lgpl; licensed under (the )?lgpl
lgpl-2.1; lesser lgpl lgplv2; lesser general public license (version |v)2 1; lgpl ?v?2 1; licenses lgpl 2 1
lgpl-3.0; lesser lgpl lgplv3; lesser general public license (version |v)3( 0)?; lgpl ?v?3( 0)?; licenses lgpl 3 0
agpl-3.0; affero agpl agplv3; affero general public license( (version |v)?3( 0)?)?; agpl ?v?3( 0)?; licenses agpl 3 0; gnu agpl
gfdl; gfdl documentation; gnu free documentation license; gfdl( 1 [123])?; licenses fdl
bsd; bsd redistribution; bsd license; licensed under (the |a )?bsd; bsd style license; redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause; bsd freebsd simplified; bsd 2 clause; (2|two) clause bsd; simplified bsd license; freebsd license
bsd-3-clause; bsd revised neither; bsd 3 clause; (3|three) clause bsd; (new|revised|modified) bsd license; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote
bsd-4-clause; bsd advertising; bsd 4 clause; (4|four) clause bsd; original bsd license; all advertising materials mentioning features or use of this software must display
0bsd; bsd 0bsd; 0bsd; zero clause bsd; bsd zero clause
isc; isc permission; isc license; licensed under (the )?isc; permission to use copy modify and or distribute this software for any purpose with or without fee
mpl-1.1; mozilla mpl; mozilla public license (version |v)?1 1; mpl 1 1; mozilla org mpl mpl 1 1
mpl-2.0; mozilla mpl; mozilla public license (version |v)?2 0; mpl 2 0; mozilla org mpl 2 0; this source code form is subject to the terms of the mozilla public license
epl-1.0; eclipse epl; eclipse public license (version |v)?1 0; epl (v )?1 0; eclipse org legal epl v10
epl-2.0; eclipse epl; eclipse public license (version |v)?2 0; epl (v )?2 0; eclipse org legal epl (v20|2 0)
edl-1.0; eclipse edl; eclipse distribution license( (version |v)?1 0)?; edl 1 0
cddl-1.0; cddl; common development and distribution license; cddl (version |v)?1 [01]; opensource org licenses cddl
cpl-1.0; common cpl; common public license( version 1 0)?; cpl 1 0
ipl-1.0; ibm; ibm public license; ibm public license version 1 0
eupl; eupl european; european union public licen[cs]e; eupl (version |v )?1 [0-2]; licensed under the eupl
unlicense; unlicense unencumbered; the unlicense; this is free and unencumbered software released into the public domain; unlicense org
wtfpl; wtfpl fuck; do what the fuck you want to public license; wtfpl( version 2)?; licensed under (the )?wtfpl
zlib; zlib; zlib license; zlib libpng license; licensed under (the )?zlib
libpng; libpng; libpng license; png reference library license
boost; boost bsl; boost software license( (version )?1 0)?; bsl 1 0; boost org license 1 0
cc0-1.0; cc0 dedication; cc0( 1 0)?; creative commons zero; public domain dedication; creativecommons org publicdomain zero 1 0
cc-by; creative creativecommons cc; creative commons attribution( license)?; cc by( [1-4] [05])?; creativecommons org licenses by( [1-4] [05])?; licensed under (a )?creative commons
cc-by-sa; creative creativecommons cc; creative commons attribution share ?alike; cc by sa; creativecommons org licenses by sa
cc-by-nd; creative creativecommons cc; creative commons attribution no ?deriv(ative)?s?; cc by nd; creativecommons org licenses by nd
cc-by-nc; creative creativecommons cc; creative commons attribution non ?commercial; cc by nc; creativecommons org licenses by nc
cc-by-nc-sa; creative creativecommons cc; creative commons attribution non ?commercial share ?alike; cc by nc sa; creativecommons org licenses by nc sa
cc-by-nc-nd; creative creativecommons cc; creative commons attribution non ?commercial no ?deriv(ative)?s?; cc by nc nd; creativecommons org licenses by nc nd
artistic-1.0; artistic; artistic license (version )?1 0; perl artistic license; clarified artistic license
artistic-2.0; artistic; artistic license (version )?2 0; artistic 2 0
psf; python psf; python software foundation license; psf license( agreement)?; psf license version 2
python-2.0; python cnri; python license( 2 0)?; cnri open source license agreement
php; php; php license( (version |v)?3 0 ?1?)?; php 3 01; licensed under (the )?php license
ruby; ruby; ruby license; ruby s license; licensed under the same terms as ruby
perl; perl; same terms as perl( 5)? itself; perl 5 license
openssl; openssl; openssl license; dual openssl ssleay license; this product includes software developed by the openssl project
ssleay; ssleay cryptsoft; ssleay license; original ssleay license
curl; curl; curl license; the curl license
x11; x11 consortium; x11 license; x consortium license; mit x11
xfree86; xfree86; xfree86 license( 1 1)?; xfree86 project licence
ncsa; ncsa illinois; university of illinois ncsa( open source license)?; ncsa license; illinois open source license
w3c; w3c; w3c software (notice and )?license; w3c document license
osl-3.0; osl open; open software license( (version |v )?3 0)?; osl 3 0
afl-3.0; afl academic; academic free license( (version |v )?[123] [01])?; afl 3 0
apsl; apple apsl; apple public source license; apsl 2 0
qpl; qpl qt; q public license; qpl 1 0; qt public license
sleepycat; sleepycat; sleepycat license; sleepycat public license
postgresql; postgresql; postgresql licen[cs]e; licensed under (the )?postgresql
vim; vim; vim license; vim charityware license
beerware; beerware beer; beerware( license)?; the beer ware license
json; evil json; the software shall be used for good not evil; json license
sissl; sissl sun; sun industry standards source license; sissl 1 [12]
ms-pl; microsoft ms; microsoft public license; ms pl
ms-rl; microsoft ms; microsoft reciprocal license; ms rl
upl-1.0; upl universal; universal permissive license( (version |v )?1 0)?; upl 1 0
ofl-1.1; ofl sil font; sil open font license( (version )?1 1)?; ofl 1 1; open font license
odbl; odbl database; open (data commons open )?database license; odbl( (v )?1 0)?
odc-by; odc attribution; odc by; open data commons attribution license
pddl; pddl; pddl( 1 0)?; open data commons public domain dedication
cecill; cecill; cecill( (version )?[12] [01])?( free software license agreement)?; cecill (b|c) license
sspl; sspl server; server side public license( (version |v)?1)?; sspl 1 0
busl; business busl bsl; business source license( 1 1)?; busl 1 1
elastic-2.0; elastic; elastic license( 2 0)?; licensed under the elastic license
commons-clause; commons; commons clause( license condition)?; commons clause v1 0
polyform; polyform; polyform (noncommercial|strict|shield|perimeter|small business|internal use) license; polyform project
hippocratic; hippocratic; hippocratic license( [23] [01])?; hippocratic 2 1
mulan; mulan mulanpsl; mulan p(ermissive )?s(oftware )?l(icense)?; mulanpsl 2 0
blueoak; blueoak blue; blue oak model license; blueoak 1 0 0
ecl-2.0; educational ecl; educational community license( (version )?2 0)?; ecl 2 0
naist; naist; nara institute of science and technology license; naist license
unicode; unicode; unicode (inc )?license agreement( data files and software)?; unicode dfs 20(15|16); unicode license v3
icu; icu; icu license; icu 1 8 1 and later
ijg; jpeg ijg; independent jpeg group license; ijg license
freetype; freetype ftl; freetype (project )?license; ftl license
gpl-classpath; classpath; classpath exception( 2 0)?; gpl with (the )?classpath exception; linking this library statically or dynamically with other modules
llvm-exception; llvm; apache 2 0 with llvm exceptions?; llvm exceptions? to the apache
public-domain; public domain; (released|placed|dedicated) (in|into|to) the public domain; this (file|code|work) is in the public domain; public domain software
proprietary; rights proprietary confidential; all rights reserved; proprietary and confidential; unauthorized copying of this file; may not be (copied|reproduced|redistributed) without (the )?(prior )?written permission
"""


#: Words too common to be a gate where there is another.
COMMON = set("a all an and any at be by code for free general in is later license licensed licenses may not of on open or org public software source terms that the this to under use v version with without".split())
#: What the signatures use for some words in between.
BETWEEN = ".{1,80}?"


class Rule(NamedTuple):
    label: str
    gates: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


def variants(signature: str, between: str = "") -> list[str]:
    """All texts that a signature stands for, with ``between`` in place of words in between."""

    def read(i: int) -> tuple[list[str], int]:
        done, now = [], [""]
        while i < len(signature) and signature[i] != ")":
            if signature[i] == "|":
                done, now, i = done + now, [""], i + 1
                continue
            if signature[i] == "(":
                part, i = read(i + 1)
                i += 1
            elif signature[i] == "[":
                stop = signature.index("]", i)
                inside = signature[i + 1 : stop]
                part = [chr(c) for c in range(ord(inside[0]), ord(inside[2]) + 1)] if inside[1:2] == "-" else list(inside)
                i = stop + 1
            elif signature.startswith(BETWEEN, i):
                part, i = [between], i + len(BETWEEN)
            else:
                part, i = [signature[i]], i + 1
            if signature[i : i + 1] == "?":
                part, i = [*part, ""], i + 1
            now = [x + y for x in now for y in part]
        return done + now, i

    return read(0)[0]


def gates_of(signature: str, preferred: list[str]) -> tuple[str, ...]:
    """For each variant of a signature one of its words: a preferred one, else one that isn't common or a number; words of most variants first, then the longest."""
    each = [set(v.split()) for v in variants(signature)]
    rank = lambda w: (w in preferred, w not in COMMON and not w.isdigit(), sum(w in x for x in each), len(w), w)
    return tuple(sorted({max(x, key=rank) for x in each}))


def rules() -> list[Rule]:
    """All signatures in their order; each licence also has its identifier tag as the strongest one."""
    out = []
    for line in LICENSES.strip().splitlines():
        label, gates, *signatures = (x.strip() for x in line.split("; "))
        tag = re.sub(r"\W+", " ", label)
        out.append(Rule(label, ("spdx",), re.compile(rf"(?<!\S)spdx license identifier {tag}(?!\S)"), 3, 0.99))
        for k, s in enumerate(signatures):
            out.append(Rule(label, gates_of(s, gates.split()), re.compile(rf"(?<!\S)(?:{s})(?!\S)"), 2 if k == 0 else 1, 0.9 if k == 0 else 0.75))
    return out
