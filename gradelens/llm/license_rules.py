"""The ordered signature rules of the license scan.

A line is ``label | level | pattern``.  Patterns are regular expressions over lower-cased words with one space between them and match
whole words; ``<n>`` stands for up to n words.  A rule's keywords, the words that every match holds, follow from its pattern
(``keywords``); every rule must have one.  Levels: 1 license text, 2 notice or identifier, 3 name with version, 4 bare name; a lower level wins, then the earlier line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TEXTS = """
mit | 1 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | the above copyright notice and this permission notice<3> shall be included in all copies or substantial portions of the software
mit-0 | 1 | permission is hereby granted free of charge to any person obtaining a copy of this software<40> to do so the software is provided as is
x11 | 1 | except as contained in this notice the name of the x consortium shall not be used in advertising
isc | 1 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | 1 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | 1 | permission to use copy modify(?: and)? distribute<6> this software and its documentation for any purpose<4> without fee is hereby granted provided that the above copyright notice appears? in all copies
postgresql | 1 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ntp | 1 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
bsl-1.0 | 1 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ofl-1.1 | 1 | permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode-dfs | 1 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
curl | 1 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
vim | 1 | there are no restrictions on distributing unmodified copies of vim<40> license
bsd-4-clause | 1 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | 1 | neither the names? of<14> nor the names of (?:its|their|other) contributors may be used to endorse or promote products derived
bsd-3-clause-clear | 1 | no express or implied licenses to any party s patent rights are granted by this license
bsd-2-clause | 1 | redistributions? of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | 1 | redistributions? in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-1-clause | 1 | redistribution and use in source and binary forms with or without modification are permitted
apache-2.0 | 1 | you may not use this file except in compliance with the license
apache-2.0 | 1 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | 1 | apache license version 2 0 january 2004
apache-1.1 | 1 | the names? apache<10> must not be used to endorse or promote products derived from this software
apache-1.1 | 1 | this product includes software developed by the apache (?:software foundation|group)
gpl-3.0-or-later | 1 | under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or<4> any later version
gpl-2.0-or-later | 1 | under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or<4> any later version
gpl-1.0-or-later | 1 | under the terms of the gnu general public license as published by the free software foundation either version 1 or<4> any later version
gpl-2.0-only | 1 | under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3.0-only | 1 | under the terms of the gnu general public license version 3 as published by the free software foundation
lgpl-3.0-or-later | 1 | under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or<4> any later version
lgpl-2.1-or-later | 1 | under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or<4> any later version
lgpl-2.0-or-later | 1 | under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or<4> any later version
agpl-3.0-or-later | 1 | under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or<4> any later version
gfdl-1.3 | 1 | under the terms of the gnu free documentation license version 1 3 or any later version
gfdl-1.2 | 1 | under the terms of the gnu free documentation license version 1 2 or any later version
gfdl-1.1 | 1 | under the terms of the gnu free documentation license version 1 1 or any later version
gpl | 1 | you should have received a copy of the gnu general public license along with this (?:program|file|library|software)
lgpl | 1 | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl | 1 | you should have received a copy of the gnu affero general public license along with
gpl | 1 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl | 1 | the licenses for most software are designed to take away your freedom to share and change it
mpl-2.0 | 1 | this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1 | 1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | 1 | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | 1 | the contents of this file are subject to the netscape public license version 1 1
cddl-1.0 | 1 | the contents of this file are subject to the terms of the common development and distribution license
epl-1.0 | 1 | under the terms of the eclipse public license v1 0 which accompanies this distribution
epl-2.0 | 1 | under the terms of the eclipse public license (?:v |version )?2 0 which is available at
epl-2.0 | 1 | the accompanying program is provided under the terms of this eclipse public license
cpl-1.0 | 1 | the accompanying program is provided under the terms of this common public license
ipl-1.0 | 1 | the accompanying program is provided under the terms of this ibm public license
unlicense | 1 | this is free and unencumbered software released into the public domain
cc0-1.0 | 1 | to the extent possible under law<24> waived all copyright and related or neighboring rights
cc0-1.0 | 1 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives
wtfpl | 1 | do what the fuck you want to public license
wtfpl | 1 | you just do what the fuck you want to
zlib | 1 | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib | 1 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng | 1 | the png reference library is supplied as is
json | 1 | the software shall be used for good not evil
beerware | 1 | if we meet some day and you think this stuff is worth it you can buy me a beer in return
openssl | 1 | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | 1 | this product includes php<6> freely available from
artistic-1.0 | 1 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2.0 | 1 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
ms-pl | 1 | this license governs use of the accompanying software if you use the software you accept this license
eupl-1.2 | 1 | licensed under the eupl(?: version)? 1 2(?: or as soon they will be approved)?
eupl-1.1 | 1 | licensed under the eupl(?: version)? 1 1
osl-3.0 | 1 | licensed under the open software license version 3 0
afl-3.0 | 1 | licensed under the academic free license version 3 0
odbl-1.0 | 1 | is made available under the open database license
odc-by-1.0 | 1 | is made available under the open data commons attribution license
pddl-1.0 | 1 | is made available under the public domain dedication and license
sspl-1.0 | 1 | under the terms of the server side public license version 1 as published by mongodb
elastic-2.0 | 1 | you may not provide the software to third parties as a hosted or managed service
commons-clause | 1 | the software is provided to you by the licensor under the license as defined below subject to the following condition
busl-1.1 | 1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
mulanpsl-2.0 | 1 | is licensed under mulan psl v2
cecill-2.1 | 1 | governed by the cecill license under french law
intel-acpi | 1 | intel grants free of charge to any person a fully paid up perpetual
proprietary | 1 | no part of this (?:publication|book|work|document) may be reproduced<24> without the prior written permission
proprietary | 1 | unauthori[sz]ed copying of this file<6> is strictly prohibited
"""

NOTICES = """
mit | 2 | (?:licen[sc]ed|released|distributed|available|published|provided) under<4> (?:mit|expat) licen[sc]e
mit | 2 | (?:licen[sc]e|licence) mit
apache-2.0 | 2 | (?:licen[sc]ed|released|distributed|available|published|provided) under<4> apache licen[sc]e(?: version| v)? v?2(?: 0)?
apache | 2 | (?:licen[sc]ed|released|distributed|available|published|provided) under<4> apache licen[sc]e
bsd | 2 | (?:licen[sc]ed|released|distributed|available|published|provided) under<4> bsd(?: style)? licen[sc]e
bsd-3-clause | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> (?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd) licen[sc]e
bsd-2-clause | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) licen[sc]e
gpl-3.0 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> general public licen[sc]e(?: version| v)? v?3(?: 0)?
gpl-2.0 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> general public licen[sc]e(?: version| v)? v?2(?: 0)?
lgpl-3.0 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> lesser general public licen[sc]e(?: version| v)? v?3(?: 0)?
lgpl-2.1 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> lesser general public licen[sc]e(?: version| v)? v?2 1
agpl-3.0 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> affero general public licen[sc]e(?: version| v)? v?3(?: 0)?
gpl | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> gpl
gpl-2.0 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> (?:gpl(?: version| v)? v?2(?: 0)?|gplv2)
gpl-3.0 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> (?:gpl(?: version| v)? v?3(?: 0)?|gplv3)
lgpl | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> lgpl[v0-9]*
agpl | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> agpl[v0-9]*
mpl-2.0 | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> mozilla public licen[sc]e(?: version| v)? v?2(?: 0)?
mpl | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> mozilla public licen[sc]e
epl | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> eclipse public licen[sc]e
isc | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> isc licen[sc]e
zlib | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> zlib licen[sc]e
artistic | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> artistic licen[sc]e
cc0-1.0 | 2 | (?:licen[sc]ed|released|dedicated|distributed|available|published) under<4> cc0
cc | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> creative commons
cc | 2 | (?:licen[sc]ed|released|distributed|available|published) under<2> cc by
wtfpl | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> wtfpl
unlicense | 2 | (?:licen[sc]ed|released|distributed|available|published) under<4> unlicense
public-domain | 2 | (?:released|placed|dedicated)<4> (?:in|into|to) the public domain
public-domain | 2 | this (?:work|file|software|text|code|document|book) is in the public domain
python-2.0 | 2 | licensed under<4> python software foundation licen[sc]e
python-2.0 | 2 | licensed under<4> psf licen[sc]e
perl | 2 | (?:you can redistribute it and or modify it )?under the same terms as perl itself
ruby | 2 | (?:distributed|licensed|available) under<6> ruby s? ?licen[sc]e
ofl-1.1 | 2 | (?:licen[sc]ed|released|distributed|available) under<4> (?:sil )?ofl
ofl-1.1 | 2 | (?:licen[sc]ed|released|distributed|available) under<4> (?:sil )?open font licen[sc]e
dual | 2 | dual licen[sc]ed under
proprietary | 2 | all rights reserved<6> (?:proprietary|confidential)
proprietary | 2 | (?:this is )?proprietary (?:and confidential )?software<6> licen[sc]e agreement
eula | 2 | end user licen[sc]e agreement
cc | 2 | creativecommons org licenses<4>
gpl | 2 | gnu org licenses(?: old licenses)? gpl[^ ]*
lgpl | 2 | gnu org licenses(?: old licenses)? lgpl[^ ]*
agpl | 2 | gnu org licenses agpl[^ ]*
apache-2.0 | 2 | apache org licenses license 2 0
mit | 2 | opensource org licenses mit(?: license)?
bsd | 2 | opensource org licenses bsd[^ ]*
mpl-2.0 | 2 | mozilla org(?: en us)? mpl 2 0
unlicense | 2 | unlicense org
"""

NAMES = """
apache-2.0 | 3 | apache(?: software)? licen[sc]e(?: version| v)? v?2(?: 0)?
apache-1.1 | 3 | apache(?: software)? licen[sc]e(?: version| v)? v?1 1
apache-1.0 | 3 | apache(?: software)? licen[sc]e(?: version| v)? v?1 0
gpl-3.0 | 3 | general public licen[sc]e(?: version| v)? v?3(?: 0)?
gpl-2.0 | 3 | general public licen[sc]e(?: version| v)? v?2(?: 0)?
gpl-1.0 | 3 | general public licen[sc]e(?: version| v)? v?1(?: 0)?
lgpl-3.0 | 3 | lesser general public licen[sc]e(?: version| v)? v?3(?: 0)?
lgpl-2.1 | 3 | lesser general public licen[sc]e(?: version| v)? v?2 1
lgpl-2.0 | 3 | library general public licen[sc]e(?: version| v)? v?2(?: 0)?
agpl-3.0 | 3 | affero general public licen[sc]e(?: version| v)? v?3(?: 0)?
gpl-3.0 | 3 | (?:gnu )?gplv3(?: 0)?
gpl-3.0 | 3 | (?:gnu )?gpl(?: v3| 3| version 3)(?: 0)?
gpl-2.0 | 3 | (?:gnu )?gplv2(?: 0)?
gpl-2.0 | 3 | (?:gnu )?gpl(?: v2| 2| version 2)(?: 0)?
lgpl-3.0 | 3 | (?:gnu )?lgplv3(?: 0)?
lgpl-3.0 | 3 | (?:gnu )?lgpl(?: v3| 3| version 3)(?: 0)?
lgpl-2.1 | 3 | (?:gnu )?lgplv2(?: 1)
lgpl-2.1 | 3 | (?:gnu )?lgpl(?: v2| 2| version 2)(?: 1)
agpl-3.0 | 3 | (?:gnu )?agplv3(?: 0)?
agpl-3.0 | 3 | (?:gnu )?agpl(?: v3| 3| version 3)(?: 0)?
gfdl-1.3 | 3 | free documentation licen[sc]e(?: version| v)? 1 3
gfdl-1.2 | 3 | free documentation licen[sc]e(?: version| v)? 1 2
bsd-4-clause | 3 | (?:4 clause bsd|bsd 4 clause|original bsd)(?: licen[sc]e)?
bsd-3-clause | 3 | (?:3 clause bsd|bsd 3 clause|new bsd|revised bsd|modified bsd)(?: licen[sc]e)?
bsd-2-clause | 3 | (?:2 clause bsd|bsd 2 clause|simplified bsd)(?: licen[sc]e)?
0bsd | 3 | zero clause bsd(?: licen[sc]e)?
0bsd | 3 | 0bsd(?: licen[sc]e)?
mpl-2.0 | 3 | mozilla public licen[sc]e(?: version| v)? v?2(?: 0)?
mpl-1.1 | 3 | mozilla public licen[sc]e(?: version| v)? v?1 1
mpl-1.0 | 3 | mozilla public licen[sc]e(?: version| v)? v?1 0
epl-2.0 | 3 | eclipse public licen[sc]e(?: version| v)? v?2(?: 0)?
epl-1.0 | 3 | eclipse public licen[sc]e(?: version| v)? v?1(?: 0)?
cddl-1.1 | 3 | common development and distribution licen[sc]e(?: cddl)?(?: version| v)? 1 1
cddl-1.0 | 3 | common development and distribution licen[sc]e(?: cddl)?(?: version| v)? 1 0
artistic-2.0 | 3 | artistic licen[sc]e(?: version| v)? 2(?: 0)?
artistic-1.0 | 3 | artistic licen[sc]e(?: version| v)? 1(?: 0)?
eupl-1.2 | 3 | european union public licen[sc]e(?: version| v)?<1> 1 2
eupl-1.1 | 3 | european union public licen[sc]e(?: version| v)?<1> 1 1
bsl-1.0 | 3 | boost software licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
python-2.0 | 3 | python(?: software foundation)? licen[sc]e(?: version| v)? 2(?: 0)?
php-3.01 | 3 | php licen[sc]e(?: version| v)? 3 01
php-3.0 | 3 | php licen[sc]e(?: version| v)? 3 0
osl-3.0 | 3 | open software licen[sc]e(?: version| v)? 3(?: 0)?
afl-3.0 | 3 | academic free licen[sc]e(?: version| v)? 3(?: 0)?
afl-2.1 | 3 | academic free licen[sc]e(?: version| v)? 2 1
ofl-1.1 | 3 | (?:sil )?open font licen[sc]e(?: version| v)?(?: 1(?: 1)?)?
ecl-2.0 | 3 | educational community licen[sc]e(?: version| v)? 2(?: 0)?
qpl-1.0 | 3 | q public licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
cpl-1.0 | 3 | common public licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
ipl-1.0 | 3 | ibm public licen[sc]e(?: version| v)?(?: 1(?: 0)?)?
lppl-1.3c | 3 | latex project public licen[sc]e(?: version| v)?(?: 1 3c?)?
zpl-2.1 | 3 | zope public licen[sc]e(?: version| v)?(?: 2(?: 1)?)?
odbl-1.0 | 3 | open database licen[sc]e(?: odbl)?(?: version| v)?(?: 1(?: 0)?)?
sspl-1.0 | 3 | server side public licen[sc]e(?: version| v)?(?: 1)?
busl-1.1 | 3 | business source licen[sc]e(?: version| v)?(?: 1 1)?
elastic-2.0 | 3 | elastic licen[sc]e(?: version| v)?(?: 2(?: 0)?)?
cecill-2.1 | 3 | cecill(?: licen[sc]e)?(?: version| v)? 2 1
mulanpsl-2.0 | 3 | mulan (?:psl|permissive software licen[sc]e)(?: version| v)?(?: v?2)?
mit | 4 | (?:the )?mit(?: x11)? licen[sc]e
mit | 4 | (?:the )?expat licen[sc]e
apache | 4 | apache(?: software)? licen[sc]e
gpl | 4 | (?:gnu )?general public licen[sc]e
gpl | 4 | (?:gnu )?gpl
lgpl | 4 | (?:gnu )?(?:lesser|library) general public licen[sc]e
lgpl | 4 | (?:gnu )?lgpl
agpl | 4 | (?:gnu )?affero general public licen[sc]e
agpl | 4 | (?:gnu )?agpl
gfdl | 4 | (?:gnu )?free documentation licen[sc]e
bsd | 4 | bsd(?: style| like)? licen[sc]e
mpl | 4 | mozilla public licen[sc]e
epl | 4 | eclipse public licen[sc]e
cddl | 4 | common development and distribution licen[sc]e
isc | 4 | isc licen[sc]e
zlib | 4 | zlib(?: libpng)? licen[sc]e
artistic | 4 | artistic licen[sc]e
eupl | 4 | european union public licen[sc]e
wtfpl | 4 | wtfpl
unlicense | 4 | (?:the )?unlicense
cc0-1.0 | 4 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
cc | 4 | creative commons(?: licen[sc]e)?
public-domain | 4 | public domain(?: dedication)?
python-2.0 | 4 | python software foundation licen[sc]e
openssl | 4 | openssl licen[sc]e
php | 4 | php licen[sc]e
ruby | 4 | ruby(?: s)? licen[sc]e
vim | 4 | vim licen[sc]e
w3c | 4 | w3c(?: software)?(?: notice and)? licen[sc]e
ncsa | 4 | (?:university of illinois )?ncsa open source licen[sc]e
ms-pl | 4 | microsoft public licen[sc]e
ms-rl | 4 | microsoft reciprocal licen[sc]e
upl-1.0 | 4 | universal permissive licen[sc]e
beerware | 4 | beerware licen[sc]e
beerware | 4 | beer ware licen[sc]e
x11 | 4 | x11 licen[sc]e
postgresql | 4 | postgresql licen[sc]e
ntp | 4 | ntp licen[sc]e
curl | 4 | curl licen[sc]e
icu | 4 | icu licen[sc]e
unicode | 4 | unicode licen[sc]e(?: agreement)?
tcl | 4 | tcl(?: tk)? licen[sc]e
sleepycat | 4 | sleepycat licen[sc]e
watcom-1.0 | 4 | (?:sybase )?open watcom public licen[sc]e
rpl | 4 | reciprocal public licen[sc]e
sissl | 4 | sun industry standards source licen[sc]e
npl | 4 | netscape public licen[sc]e
nasa-1.3 | 4 | nasa open source agreement
hpnd | 4 | historical permission notice and disclaimer
cecill | 4 | cecill(?: [abc])? licen[sc]e
commons-clause | 4 | commons clause
shareware | 4 | shareware licen[sc]e
freeware | 4 | freeware licen[sc]e
"""

#: Creative Commons licenses: (label, words of the name, words of the short form), each with every version.
COMMONS = (
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share ?alike", "by sa"),
    ("cc-by-nd", "attribution no ?deriv(?:s|atives|ativeworks)", "by nd"),
    ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:s|atives|ativeworks)", "by nc nd"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


@dataclass(frozen=True)
class Rule:
    label: str
    level: int
    pattern: str
    base: bool = False


def expansions(tree) -> list[str]:
    """Texts that a parsed pattern matches: every branch and small class in turn, what may repeat once and (if it may) not at all."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            part = [chr(arg)]
        elif kind == "NOT_LITERAL":
            part = ["?"]
        elif kind == "IN":
            negated = str(arg[0][0]) == "NEGATE"
            part = ["?"] if negated or any(str(k) != "LITERAL" for k, _ in arg) else [chr(c) for _, c in arg]
        elif kind == "MAX_REPEAT":
            part = expansions(arg[2]) + ([""] if arg[0] == 0 else [])
        elif kind == "SUBPATTERN":
            part = expansions(arg[3])
        elif kind == "BRANCH":
            part = [x for branch in arg[1] for x in expansions(branch)]
        else:
            raise ValueError(f"pattern with {kind}")
        out = [a + b for a in out for b in part]
    return out


def keywords(pattern: str) -> tuple[str, ...]:
    """The words that every match of a pattern holds, longest first."""
    texts = expansions(re._parser.parse(re.sub(r"<\d+>", "", pattern)))
    common = set.intersection(*(set(t.split()) for t in texts))
    if not common:
        raise ValueError(f"no word is in every match of '{pattern}'")
    return tuple(sorted(common, key=lambda w: (-len(w), w)))


def listed(lines: str) -> list[Rule]:
    out = []
    for line in lines.strip().splitlines():
        label, level, pattern = (part.strip() for part in line.split(" | ", 2))
        out.append(Rule(label, int(level), pattern))
    return out


def commons_rules() -> list[Rule]:
    """Name and short form of each Creative Commons license, with each version (level 3) and without (level 4)."""
    out = []
    for label, name, short in COMMONS:
        for v in COMMONS_VERSIONS:
            number = v.replace(".", " ")
            out.append(Rule(f"{label}-{v}", 3, f"creative commons(?: licen[sc]e)? {name} {number}"))
            out.append(Rule(f"{label}-{v}", 3, f"cc {short} {number}"))
        out.append(Rule(label, 4, f"creative commons(?: licen[sc]e)? {name}"))
        out.append(Rule(label, 4, f"cc {short}"))
    return out


def identifier_rules(rules: list[Rule]) -> list[Rule]:
    """``SPDX-License-Identifier: <label>`` for every label of the other rules."""
    labels = dict.fromkeys(r.label for r in rules)
    return [Rule(x, 2, "spdx license identifier " + x.replace("-", " ").replace(".", " ")) for x in sorted(labels, key=lambda x: (-len(x), x))]


#: The phrases of the base count, with their labels; their places are never suppressed.
BASE = (Rule("mit", 4, "mit license", True), Rule("apache", 4, "apache license", True),
        Rule("gpl", 4, "general public license", True))


def default_rules() -> tuple[Rule, ...]:
    rules = [*listed(TEXTS), *listed(NOTICES), *listed(NAMES), *commons_rules()]
    return (*BASE, *identifier_rules(rules), *rules)
