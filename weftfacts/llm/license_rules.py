"""Hand-written licence signatures: (label, priority, keyword, regular expression).

They are matched against a text's words, lower-cased and joined by single spaces. A word is a run of a-z, 0-9 and
non-ASCII characters, so "GPL-2.0+" reads "gpl 2 0". The keyword must occur in every match; it gates the expression.
Priority 4: text of a grant; 3: a full title with version or an identifier; 2: a title; 1: a hint.
"""

from __future__ import annotations

# One rule a line: label | priority | keyword | expression. W stands for up to three words between.
_TEXT = r"""
mit|4|free of charge|permission is hereby granted free of charge to any person obtaining a copy
mit|4|sublicense|use copy modify merge publish distribute sublicense and or sell copies
mit|4|as is|the software is provided as is without warranty of any kind express or implied including but not limited to
mit|3|spdx|spdx license identifier mit(?: 0)?
mit|3|opensource|opensource org licenses mit(?: license)?
mit|3|mit|(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?mit(?: x11| expat)?(?: open source)? licen[cs]e
mit|2|mit|mit (?:style |x11 |expat |open source )licen[cs]e
mit|2|mit|licen[cs]ed? mit
mit|2|expat|expat licen[cs]e
mit|1|mit|mit licensed
x11|3|x11|x11 licen[cs]e
x11|3|spdx|spdx license identifier x11
apache|4|apache|licensed under the apache license version 2 0 the license
apache|4|apache|you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org
apache|4|compliance|you may not use this file except in compliance with the license
apache|4|conditions|distributed on an as is basis without warranties or conditions of any kind
apache|3|spdx|spdx license identifier apache [12] [01]
apache|3|apache|apache (?:software )?licen[cs]e(?: version)? (?:2 0|1 1|1 0|2)
apache|3|apache|www apache org licenses(?: license 2 0)?
apache|3|apache|apache 2 0(?: licen[cs]ed?)?
apache|2|apache|apache software licen[cs]e
apache|2|asl|asl 2 0
apache|1|apache|apache licensed
gpl|4|redistribute|you can redistribute it and or modify it under the terms of the gnu general public license
gpl|4|useful|in the hope that it will be useful but without any warranty
gpl|4|merchantability|without even the implied warranty of merchantability or fitness for a particular purpose
gpl|4|received|you should have received a copy of the gnu general public license
gpl|4|temple place|59 temple place suite 330
gpl|4|franklin|51 franklin (?:st|street) fifth floor
gpl|3|spdx|spdx license identifier gpl [123] 0(?: only| or later)?
gpl|3|gnu general public|gnu general public license(?: as published by the free software foundation)?(?: either)? ?version [123]
gpl|3|gnu|gnu gpl(?: version| v)? ?[123](?: 0)?
gpl|3|gnu|www gnu org licenses(?: old licenses)? gpl(?: [123] 0)?
gpl|3|gplv|gplv[123]
gpl|3|gpl|gpl (?:version |v ?)?[123](?: 0)?(?: only| or later)?
gpl|2|gnu general public|gnu general public licen[cs]e
gpl|2|gnu|gnu gpl
gpl|2|gpl|(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gpl
gpl|1|gpl|gpl licensed
gpl|1|copyleft|copyleft licen[cs]e
lgpl|4|lesser|you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl|4|received|you should have received a copy of the gnu (?:lesser|library) general public license
lgpl|3|spdx|spdx license identifier lgpl [23] [01](?: only| or later)?
lgpl|3|lgplv|lgplv[23](?: 1)?
lgpl|3|lgpl|lgpl (?:version |v ?)?(?:2 0|2 1|2|3 0|3)(?: only| or later)?
lgpl|3|gnu|www gnu org licenses(?: old licenses)? lgpl(?: [23] [01])?
lgpl|3|general public|gnu (?:lesser|library) general public license version (?:2 1|2|3)
lgpl|2|general public|(?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl|2|gnu|gnu lgpl
lgpl|1|lgpl|lgpl licensed
agpl|4|affero|you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl|4|received|you should have received a copy of the gnu affero general public license
agpl|3|spdx|spdx license identifier agpl [13] 0(?: only| or later)?
agpl|3|agplv|agplv[13]
agpl|3|agpl|agpl (?:version |v ?)?[13](?: 0)?(?: only| or later)?
agpl|3|gnu|www gnu org licenses agpl(?: 3 0)?
agpl|2|affero|(?:gnu )?affero general public licen[cs]e(?: version 3)?
agpl|2|affero|affero gpl
gfdl|4|free documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl|3|spdx|spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl|3|gfdl|gfdl (?:version )?1 [123]
gfdl|2|free documentation|gnu free documentation licen[cs]e(?: version 1 [123])?
gfdl|1|fdl|gnu fdl
bsd|4|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd|4|redistributions|redistributions of source code must retain the above copyright notice
bsd|4|redistributions|redistributions in binary form must reproduce the above copyright notice
bsd|4|endorse|neither the name of W nor the names of its contributors may be used to endorse or promote products
bsd|4|advertising|all advertising materials mentioning features or use of this software must display
bsd|4|consequential|in no event shall W be liable for any direct indirect incidental special exemplary or consequential damages
bsd|3|spdx|spdx license identifier (?:bsd [1234] clause|0bsd)(?: clear| patent| views)?
bsd|3|opensource|opensource org licenses bsd(?: [23] clause| license)?
bsd|3|bsd|(?:bsd [01234] clause|[01234] clause bsd|(?:two|three|four|2|3|4) clause bsd)(?: licen[cs]e)?
bsd|3|bsd|(?:new|modified|revised|simplified|original|free) bsd(?: licen[cs]e)?
bsd|2|bsd|bsd (?:style )?licen[cs]e
bsd|2|berkeley|berkeley software distribution licen[cs]e
bsd|1|bsd|bsd licensed
0bsd|4|purpose|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd|3|0bsd|0bsd(?: licen[cs]e)?
isc|4|isc|the software is provided as is and isc disclaims all warranties
isc|4|disclaims|the author disclaims all warranties with regard to this software
isc|3|spdx|spdx license identifier isc
isc|3|opensource|opensource org licenses isc(?: license)?
isc|2|isc|isc licen[cs]e
isc|2|internet systems|internet systems consortium licen[cs]e
mpl|4|mozilla|this source code form is subject to the terms of the mozilla public license
mpl|4|mozilla|the contents of this file are subject to the mozilla public license
mpl|4|mpl|if a copy of the mpl was not distributed with this file you can obtain one
mpl|3|spdx|spdx license identifier mpl [12] [01]
mpl|3|mozilla|mozilla org mpl(?: [12] [01])?
mpl|3|mpl|mpl (?:version |v ?)?(?:1 0|1 1|2 0|2)
mpl|3|mozilla|mozilla public licen[cs]e version [12] [01]
mpl|2|mozilla|mozilla public licen[cs]e
epl|4|eclipse|made available under the terms of the eclipse public license
epl|4|accompanying|this program and the accompanying materials are made available under the terms of
epl|3|spdx|spdx license identifier epl [12] 0
epl|3|eclipse|www eclipse org (?:legal|org documents) epl(?: v[12]0| 2 0)?
epl|3|epl|epl (?:version |v ?)?[12](?: 0)?
epl|2|eclipse|eclipse public licen[cs]e(?: version [12](?: 0)?)?
edl|3|spdx|spdx license identifier bsd 3 clause edl
edl|2|eclipse|eclipse distribution licen[cs]e(?: v(?:ersion)? 1 0)?
cddl|4|common development|the contents of this file are subject to the terms of the common development and distribution license
cddl|3|spdx|spdx license identifier cddl 1 [01]
cddl|3|cddl|cddl (?:version |v ?)?1 [01]
cddl|2|common development|common development and distribution licen[cs]e
cpl|3|spdx|spdx license identifier cpl 1 0
cpl|2|common public|common public licen[cs]e(?: version 1 0)?
ipl|3|spdx|spdx license identifier ipl 1 0
ipl|2|ibm|ibm public licen[cs]e(?: version 1 0)?
unlicense|4|unencumbered|this is free and unencumbered software released into the public domain
unlicense|4|dedication|we make this dedication for the benefit of the public at large
unlicense|3|spdx|spdx license identifier unlicense
unlicense|3|unlicense|(?:http )?unlicense org
unlicense|2|unlicense|the unlicense
wtfpl|4|what the|do what the fuck you want to(?: public licen[cs]e)?
wtfpl|3|spdx|spdx license identifier wtfpl
wtfpl|2|wtfpl|wtfpl(?: version 2)?
zlib|4|misrepresented|the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib|4|altered|altered source versions must be plainly marked as such
zlib|4|held liable|in no event will the authors be held liable for any damages arising from the use of this software
zlib|3|spdx|spdx license identifier zlib(?: acknowledgement)?
zlib|2|zlib|zlib(?: libpng)? licen[cs]e
boost|4|boost|distributed under the boost software license version 1 0
boost|4|derivative works|must be included in all copies of the software in whole or in part and all derivative works W unless such copies
boost|3|spdx|spdx license identifier bsl 1 0
boost|3|boost|boost org license(?: 1 0(?: txt)?)?
boost|2|boost|boost software licen[cs]e(?: version 1 0)?
artistic|4|artistic|under the terms of the artistic license
artistic|3|spdx|spdx license identifier artistic [12] 0(?: perl| cl8)?
artistic|3|artistic|artistic licen[cs]e (?:version )?[12] 0
artistic|2|artistic|artistic licen[cs]e
perl|4|perl|under the same terms as perl itself
perl|2|perl|perl artistic licen[cs]e
python|4|python|psf license agreement for python
python|3|spdx|spdx license identifier (?:psf 2 0|python 2 0(?: 1)?)
python|2|python|python software foundation licen[cs]e(?: version 2)?
php|4|php|this product includes php software freely available from
php|3|spdx|spdx license identifier php 3 0[01]?
php|2|php|php licen[cs]e(?: version 3 01)?
ruby|4|ruby|under the same terms as ruby(?: itself)?
ruby|3|spdx|spdx license identifier ruby
ruby|2|ruby|ruby licen[cs]e
openssl|4|openssl|this product includes software developed by the openssl project
openssl|3|spdx|spdx license identifier openssl
openssl|2|openssl|openssl licen[cs]e
ssleay|4|eric young|this product includes cryptographic software written by eric young
ssleay|2|ssleay|(?:original )?ssleay licen[cs]e
curl|3|spdx|spdx license identifier curl
curl|2|curl|curl licen[cs]e
ijg|4|independent jpeg|this software is based in part on the work of the independent jpeg group
ijg|3|spdx|spdx license identifier ijg
libpng|4|png reference|the png reference library is supplied as is
libpng|3|spdx|spdx license identifier libpng(?: 2 0)?
libpng|2|libpng|libpng licen[cs]e
ftl|4|freetype|portions of this software are copyright W the freetype project
ftl|3|spdx|spdx license identifier ftl
ftl|2|freetype|freetype (?:project )?licen[cs]e
bzip2|3|spdx|spdx license identifier bzip2 1 0 [56]
bzip2|2|bzip2|bzip2 licen[cs]e
icu|3|spdx|spdx license identifier icu
icu|2|icu|icu licen[cs]e
unicode|4|unicode|unicode data files and software
unicode|3|spdx|spdx license identifier unicode (?:dfs 201[56]|tou|3 0)
unicode|2|unicode|unicode licen[cs]e(?: agreement)?
ofl|4|open font|this font software is licensed under the sil open font license
ofl|3|spdx|spdx license identifier ofl 1 [01](?: rfn| no rfn)?
ofl|3|ofl|scripts sil org ofl
ofl|2|open font|(?:sil )?open font licen[cs]e(?: version 1 1)?
upl|3|spdx|spdx license identifier upl 1 0
upl|2|universal permissive|universal permissive licen[cs]e(?: v(?:ersion)? ?1 0)?
eupl|4|european union|licensed under the european union public licence
eupl|3|spdx|spdx license identifier eupl 1 [012]
eupl|3|eupl|eupl (?:version |v ?)?1 [012]
eupl|2|european union|european union public licen[cs]e
cecill|3|spdx|spdx license identifier cecill (?:1 [01]|2 [01]|b|c)
cecill|2|cecill|cecill(?: b| c)? licen[cs]e
cecill|2|cecill|licence cecill
mulan|3|spdx|spdx license identifier mulanpsl [12] 0
mulan|2|mulan|mulan (?:psl|permissive software licen[cs]e)(?: v2)?
ncsa|3|spdx|spdx license identifier ncsa
ncsa|2|ncsa|(?:university of illinois )?ncsa (?:open source )?licen[cs]e
ecl|3|spdx|spdx license identifier ecl [12] 0
ecl|2|educational community|educational community licen[cs]e(?: version [12] 0)?
afl|3|spdx|spdx license identifier afl [123] [01]
afl|2|academic free|academic free licen[cs]e(?: version [123] [01])?
osl|3|spdx|spdx license identifier osl [123] [01]
osl|2|open software|open software licen[cs]e(?: version [123] [01])?
ms pl|3|spdx|spdx license identifier ms pl
ms pl|2|microsoft public|microsoft public licen[cs]e
ms rl|3|spdx|spdx license identifier ms rl
ms rl|2|microsoft reciprocal|microsoft reciprocal licen[cs]e
w3c|4|w3c|w3c software notice and license
w3c|3|spdx|spdx license identifier w3c(?: 19980720| 20150513)?
w3c|2|w3c|w3c (?:software )?licen[cs]e
apsl|3|spdx|spdx license identifier apsl [12] [012]
apsl|2|apple public|apple public source licen[cs]e(?: version [12] [012])?
qpl|3|spdx|spdx license identifier qpl 1 0
qpl|2|q public|q public licen[cs]e
sleepycat|3|spdx|spdx license identifier sleepycat
sleepycat|2|sleepycat|sleepycat licen[cs]e
lppl|4|latex|distributed and or modified under the conditions of the latex project public license
lppl|3|spdx|spdx license identifier lppl 1 [0123][ac]?
lppl|2|latex|latex project public licen[cs]e
vim|3|spdx|spdx license identifier vim
vim|2|vim|vim licen[cs]e
tcl|3|spdx|spdx license identifier tcl
tcl|2|tcl|tcl tk licen[cs]e
beerware|4|beer|you can buy me a beer in return
beerware|3|spdx|spdx license identifier beerware
beerware|2|beer|(?:the )?beer ?ware licen[cs]e
json|4|good not evil|the software shall be used for good not evil
json|3|spdx|spdx license identifier json
blueoak|3|spdx|spdx license identifier blueoak 1 0 0
blueoak|2|blue oak|blue oak model licen[cs]e
postgresql|3|spdx|spdx license identifier postgresql
postgresql|2|postgresql|postgresql licen[cs]e
sspl|3|spdx|spdx license identifier sspl 1 0
sspl|2|server side public|server side public licen[cs]e(?: v(?:ersion)? ?1)?
busl|4|change date|on the change date W the licensor hereby grants you rights
busl|3|spdx|spdx license identifier busl 1 1
busl|2|business source|business source licen[cs]e(?: 1 1| version 1 1)?
elastic|3|spdx|spdx license identifier elastic 2 0
elastic|2|elastic|elastic licen[cs]e(?: 2 0| version 2)?
commons clause|4|commons clause|commons clause licen[cs]e condition v ?1 0
commons clause|2|commons clause|commons clause
polyform|3|spdx|spdx license identifier polyform (?:noncommercial|small business) 1 0 0
polyform|2|polyform|polyform (?:noncommercial|small business|shield|perimeter|strict) licen[cs]e
openrail|2|rail|(?:creativeml |bigscience )?open ?rail(?: m| s)?(?: licen[cs]e)?
llama community|2|llama|llama [234](?: [123])? community licen[cs]e
gemma|2|gemma|gemma terms of use
cc0|4|waived|to the extent possible under law W has waived all copyright
cc0|4|waived|waived all copyright and related or neighboring rights
cc0|3|spdx|spdx license identifier cc0 1 0
cc0|3|creativecommons|creativecommons org publicdomain zero(?: 1 0)?
cc0|2|cc0|cc0(?: 1 0)?(?: universal)?
cc by nc nd|3|creativecommons|creativecommons org licenses by nc nd(?: [1234] [05])?
cc by nc nd|3|cc|cc by nc nd(?: [1234] [05])?
cc by nc nd|2|deriv|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1234] [05])?
cc by nc sa|3|creativecommons|creativecommons org licenses by nc sa(?: [1234] [05])?
cc by nc sa|3|cc|cc by nc sa(?: [1234] [05])?
cc by nc sa|2|share|creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc by nc|3|creativecommons|creativecommons org licenses by nc(?: [1234] [05])?
cc by nc|3|cc|cc by nc(?: [1234] [05])?
cc by nc|2|commercial|creative commons attribution non ?commercial(?: [1234] [05])?
cc by nd|3|creativecommons|creativecommons org licenses by nd(?: [1234] [05])?
cc by nd|3|cc|cc by nd(?: [1234] [05])?
cc by nd|2|deriv|creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1234] [05])?
cc by sa|3|creativecommons|creativecommons org licenses by sa(?: [1234] [05])?
cc by sa|3|cc|cc by sa(?: [1234] [05])?
cc by sa|2|share|creative commons attribution share ?alike(?: [1234] [05])?
cc by|3|creativecommons|creativecommons org licenses by(?: [1234] [05])?
cc by|3|cc|cc by(?: [1234] [05])?
cc by|2|creative commons|creative commons attribution(?: [1234] [05])?
creative commons|1|creative commons|creative commons(?: licen[cs]e)?
pddl|2|public domain|public domain dedication and licen[cs]e
odbl|3|odbl|odbl(?: 1 0| v1 0)?
odbl|2|database|open (?:data commons )?(?:open )?database licen[cs]e
odc by|2|open data|open data commons attribution licen[cs]e
ogl|3|open government|open government licen[cs]e(?: v(?:ersion)? ?[123](?: 0)?)?
ogl|1|crown copyright|crown copyright
cdla|3|cdla|cdla (?:permissive|sharing) [12] 0
cdla|2|community data|community data licen[cs]e agreement
public domain|3|public domain|(?:released|placed|dedicated|is) (?:in|into|to) the public domain
public domain|1|public domain|public domain
proprietary|4|confidential|this (?:document|software|file) (?:is|contains) (?:proprietary and confidential|confidential and proprietary)
proprietary|4|written permission|may not be (?:reproduced|copied|distributed) W without (?:the )?(?:prior |express )?written permission
proprietary|3|proprietary|proprietary licen[cs]e
proprietary|3|end user|end user licen[cs]e agreement
proprietary|2|rights reserved|all rights reserved
proprietary|2|unauthorized|unauthorized copying of this file
proprietary|1|commercial|commercial licen[cs]e
dual|3|dual|dual licensed under
dual|2|dual|dual licen[cs](?:e|ed|ing)
copyright|1|copyright|copyright (?:c )?(?:19|20)[0-9]{2}
license file|1|license|see (?:the )?(?:license|copying) (?:file|txt|md)
license file|1|license|full license (?:text|information)
license tag|1|spdx|spdx license identifier
license tag|1|license|license ?: ?[a-z0-9]+
"""


def _read() -> list[tuple[str, int, str, str]]:
    rules = []
    for line in _TEXT.strip().split("\n"):
        label, priority, keyword, pattern = line.split("|", 3)
        rules.append((label, int(priority), keyword, pattern.replace(" W ", r" (?:[^ ]+ ){0,3}")))
    return rules


RULES = _read()
#: The base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
