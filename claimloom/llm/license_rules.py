"""Signatures of licenses, written by hand: what a license's text, a file's header, an identifier or a sentence says.

A section opens with [keyword], which every match of its rules holds. A rule is a kind, a label and a regex over
lower-case words with one space between them (no punctuation is left there: "GPL-3.0" is "gpl 3 0"). Rules are ordered by
the kind's priority, then as they stand here."""

from __future__ import annotations

#: Kind: priority, confidence.
KINDS = {"text": (100, 1.0), "header": (90, 1.0), "id": (80, 1.0), "notice": (70, 0.95), "url": (60, 0.9), "grant": (50, 0.85), "name": (40, 0.7), "short": (30, 0.6)}

SIGNATURES = """
[permission is hereby granted]
text mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
text bsl-1: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
text ofl-1.1: permission is hereby granted free of charge to any person obtaining a copy of the font software
text unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
text ncsa: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
text postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted and permission is hereby granted
[with or without fee is hereby granted]
text 0bsd: permission to use copy modify (?:and|and or|or) distribute this software for any purpose with or without fee is hereby granted
text isc: permission to use copy modify (?:and|and or|or) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
[without fee]
text postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
text hpnd: permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
text tcp-wrappers: permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
[copyright notice]
text mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
text bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
text bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
text x11: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the x consortium be liable
[authors or copyright holders]
text mit: in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise
[x consortium]
text x11: the name of the x consortium shall not be used in advertising or otherwise to promote the sale use or other dealings
[redistribution and use in source and binary forms]
text bsd: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
text bsd-clear: redistribution and use in source and binary forms with or without modification are permitted subject to the limitations in the disclaimer below
text apache-1.1: redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 the end user documentation
[contributors may be used to endorse]
text bsd-3-clause: nor the names of (?:its|the|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission
text bsd-3-clause: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
text bsd-3-clause: neither the name of the university nor the names of its contributors may be used to endorse or promote products
[advertising materials mentioning]
text bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
[bsd]
id bsd-2-clause: spdx license identifier bsd 2 clause
id bsd-3-clause: spdx license identifier bsd 3 clause
id bsd-4-clause: spdx license identifier bsd 4 clause
id 0bsd: spdx license identifier 0bsd
id bsd-1-clause: spdx license identifier bsd 1 clause
id bsd-3-clause-clear: spdx license identifier bsd 3 clause clear
url bsd-2-clause: opensource org licenses? bsd 2 clause
url bsd-3-clause: opensource org licenses? bsd 3 clause
header bsd: use of this source code is governed by a bsd style license that can be found in the license file
notice bsd-2-clause: (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
notice bsd-3-clause: (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
notice bsd: (?:licensed|released|distributed|available) under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: licen[cs]e)?
name bsd-2-clause: (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[cs]e
name bsd-3-clause: (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e
name bsd-4-clause: (?:bsd 4 clause|4 clause bsd|original bsd|old bsd) licen[cs]e
name bsd-3-clause-clear: clear bsd licen[cs]e
name bsd-2-clause-patent: bsd 2 clause plus patent
name 0bsd: (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?
name bsd: bsd(?: style)? licen[cs]e
short bsd: bsd licensed
[mit]
id mit: spdx license identifier mit
id mit-0: spdx license identifier mit 0
url mit: opensource org licenses? mit(?: license)?(?: php)?
url mit: choosealicense com licenses mit
url mit: spdx org licenses mit
notice mit: (?:re)?licensed under (?:the )?(?:terms (?:and conditions )?of the )?mit(?: x11)?(?: licen[cs]e)?
notice mit: (?:released|distributed|published|available|redistributed) under (?:the )?(?:terms (?:and conditions )?of the )?mit(?: x11)? licen[cs]e
grant mit: (?:under|subject to|according to|governed by) the (?:terms|conditions) of the mit licen[cs]e
grant mit: (?:uses?|under|see|with|by) (?:the |an? )?mit licen[cs]e
grant mit: licen[cs]ed? (?:is |type |name )?(?:the )?mit
name mit: mit(?: x11| expat)? licen[cs]e
name mit-0: mit no attribution licen[cs]e
short mit: mit licensed
short mit: dual licensed mit
[expat]
notice mit: licensed under (?:the )?(?:terms of the )?expat(?: licen[cs]e)?
grant mit: licen[cs]e expat
name mit: expat licen[cs]e
id mit: spdx license identifier expat
[x11]
id x11: spdx license identifier x11
name x11: x11 licen[cs]e
[isc]
id isc: spdx license identifier isc
notice isc: licensed under (?:the )?(?:terms of the )?isc(?: licen[cs]e)?
url isc: opensource org licenses? isc(?: license)?
name isc: isc licen[cs]e
short isc: isc licensed
[apache]
header apache-2: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
header apache-2: licensed to the apache software foundation asf under one or more contributor license agreements
id apache-1.0: spdx license identifier apache 1 0
id apache-1.1: spdx license identifier apache 1 1
id apache-2: spdx license identifier apache 2 0
text apache-1.1: this product includes software developed by the apache software foundation
text apache-2: apache license version 2 0 january 2004
url apache-2: apache org licenses license 2 0
url apache-2: opensource org licenses? apache 2 0
notice apache-2: (?:licensed|released|distributed|published|available|relicensed|redistributed) under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? 2(?: 0)?(?: licen[cs]e)?
notice apache-1.1: (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version| v)? 1 1
grant apache-2: (?:under|see|uses?|with|by|subject to|governed by) the (?:terms of the )?apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?
grant apache-2: licen[cs]e (?:is |type |name )?(?:the )?apache(?: licen[cs]e)?(?: version| v)? 2(?: 0)?
name apache-2: apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?
name apache-2: apache 2(?: 0)? licen[cs]e
name apache-1.1: apache(?: software)? licen[cs]e(?: version)? 1 1
name apache: apache(?: software)? licen[cs]e
short apache-2: apache licen[cs]e v2
short apache-2: apache 2 0
short apache-2: apache2 licensed
short apache: apache licensed
[asl]
short apache-2: asl 2 0
[lesser general public]
header lgpl-2.1: terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
header lgpl-3: terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
notice lgpl-2.1: under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: version| v)? 2 1
notice lgpl-3: under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e(?: as published by the free software foundation)?(?: version| v)? 3
name lgpl-2.1: gnu lesser general public licen[cs]e(?: version| v)? 2 1
name lgpl-3: gnu lesser general public licen[cs]e(?: version| v)? 3(?: 0)?
name lgpl-2.1: lesser general public licen[cs]e(?: version| v)? 2 1
name lgpl-3: lesser general public licen[cs]e(?: version| v)? 3(?: 0)?
name lgpl: (?:gnu )?lesser general public licen[cs]e
[library general public]
name lgpl-2: gnu library general public licen[cs]e(?: version| v)? 2(?: 0)?
name lgpl-2: (?:gnu )?library general public licen[cs]e
[affero general public]
header agpl-3: terms of the gnu affero general public license as published by the free software foundation either version 3 of the license
notice agpl-3: under (?:the )?(?:terms of the )?gnu affero general public licen[cs]e(?: version| v)? 3
name agpl-3: gnu affero general public licen[cs]e(?: version| v)? 3(?: 0)?
name agpl-1: affero general public licen[cs]e(?: version| v)? 1
name agpl: (?:gnu )?affero general public licen[cs]e
[general public]
header gpl-2: terms of the gnu general public license as published by the free software foundation either version 2 of the license
header gpl-3: terms of the gnu general public license as published by the free software foundation either version 3 of the license
header gpl-2: terms of the gnu general public license version 2 as published by the free software foundation
header gpl-3: terms of the gnu general public license version 3 as published by the free software foundation
header gpl: you should have received a copy of the gnu general public license along with this program
text gpl: the gnu general public license is a free copyleft license for software and other kinds of works
text gpl-2: gnu general public license version 2 june 1991
text gpl-3: gnu general public license version 3 29 june 2007
notice gpl-2: (?:licensed|released|distributed|published|available|relicensed|redistributed) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? 2(?: 0)?
notice gpl-3: (?:licensed|released|distributed|published|available|relicensed|redistributed) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? 3(?: 0)?
notice gpl: (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e
grant gpl-2: under the (?:terms of the )?gnu general public licen[cs]e(?: version| v)? 2(?: 0)?
grant gpl-3: under the (?:terms of the )?gnu general public licen[cs]e(?: version| v)? 3(?: 0)?
name gpl-1: gnu general public licen[cs]e(?: version| v)? 1
name gpl-2: gnu general public licen[cs]e(?: version| v)? 2(?: 0)?
name gpl-3: gnu general public licen[cs]e(?: version| v)? 3(?: 0)?
name gpl: gnu general public licen[cs]e
short gpl-2: general public licen[cs]e v2
short gpl-3: general public licen[cs]e v3
[gpl]
id agpl-3: spdx license identifier agpl 3 0(?: only| or later)?
id lgpl-2: spdx license identifier lgpl 2 0(?: only| or later)?
id lgpl-2.1: spdx license identifier lgpl 2 1(?: only| or later)?
id lgpl-3: spdx license identifier lgpl 3 0(?: only| or later)?
id gpl-1: spdx license identifier gpl 1 0(?: only| or later)?
id gpl-2: spdx license identifier gpl 2 0(?: only| or later)?
id gpl-3: spdx license identifier gpl 3 0(?: only| or later)?
id gpl-2-classpath: spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
id gpl-2-linux-syscall: spdx license identifier gpl 2 0(?: only| or later)? with linux syscall note
url gpl-2: gnu org licenses gpl 2 0
url gpl-3: gnu org licenses gpl 3 0
url lgpl-2.1: gnu org licenses lgpl 2 1
url lgpl-3: gnu org licenses lgpl 3 0
url agpl-3: gnu org licenses agpl 3 0
url gpl: gnu org licenses gpl
notice gpl-2: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?: version)? 2(?: 0)?
notice gpl-3: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl(?: version)? 3(?: 0)?
notice lgpl-2.1: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?: version)? 2 1
notice lgpl-3: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl(?: version)? 3(?: 0)?
notice gpl: (?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl
short gpl-2: gplv2
short gpl-3: gplv3
short lgpl-2.1: lgplv2 1
short lgpl-2: lgplv2
short lgpl-3: lgplv3
short agpl-3: agplv3
short gpl-2: (?:gnu )?gpl (?:version |v )?2(?: 0)?(?: only| or later)?
short gpl-3: (?:gnu )?gpl (?:version |v )?3(?: 0)?(?: only| or later)?
short lgpl-2.1: (?:gnu )?lgpl (?:version |v )?2 1(?: only| or later)?
short lgpl-3: (?:gnu )?lgpl (?:version |v )?3(?: 0)?(?: only| or later)?
short agpl-3: (?:gnu )?agpl (?:version |v )?3(?: 0)?(?: only| or later)?
short gpl-2: gpl v2
short gpl-3: gpl v3
short lgpl-3: lgpl v3
short agpl-3: agpl v3
short gpl: gpl licensed
short gpl: gpl licen[cs]e
[free documentation]
header gfdl-1.2: terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation
header gfdl-1.3: terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation
name gfdl-1.2: gnu free documentation licen[cs]e(?: version)? 1 2
name gfdl-1.3: gnu free documentation licen[cs]e(?: version)? 1 3
name gfdl: (?:gnu )?free documentation licen[cs]e
[gfdl]
id gfdl-1.3: spdx license identifier gfdl 1 3(?: only| or later)?
short gfdl: gfdl licensed
[mozilla public]
header mpl-2: this source code form is subject to the terms of the mozilla public license v 2 0
header mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
notice mpl-2: (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
name mpl-1.1: mozilla public licen[cs]e(?: version| v)? 1 1
name mpl-2: mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
name mpl: mozilla public licen[cs]e
[mpl]
id mpl-1.1: spdx license identifier mpl 1 1
id mpl-2: spdx license identifier mpl 2 0
url mpl-2: mozilla org mpl 2 0
url mpl-2: mozilla org en us mpl 2 0
short mpl-2: mpl (?:v |version )?2 0
short mpl-2: mplv2
short mpl-1.1: mpl 1 1
[eclipse]
header epl-2: made available under the terms of the eclipse public license 2 0
header epl-1: made available under the terms of the eclipse public license v1 0
notice epl-2: (?:licensed|released|distributed) under (?:the )?(?:terms of the )?eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
name epl-1: eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
name epl-2: eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
name epl: eclipse public licen[cs]e
name edl-1: eclipse distribution licen[cs]e(?: version| v)? 1 0
[epl]
id epl-1: spdx license identifier epl 1 0
id epl-2: spdx license identifier epl 2 0
url epl-2: eclipse org legal epl 2 0
url epl-1: eclipse org legal epl v10
[european union public]
header eupl-1.2: licensed under the eupl version 1 2 the european union public licence
name eupl-1.1: european union public licen[cs]e(?: version| v)? 1 1
name eupl-1.2: european union public licen[cs]e(?: version| v)? 1 2
name eupl: european union public licen[cs]e
[eupl]
id eupl-1.2: spdx license identifier eupl 1 2
notice eupl-1.2: (?:licensed|released) under (?:the )?eupl(?: version| v)? 1 2
short eupl-1.2: eupl 1 2
[common development and distribution]
header cddl-1: terms of the common development and distribution license version 1 0
name cddl-1.1: common development and distribution licen[cs]e(?: version| v)? 1 1
name cddl-1: common development and distribution licen[cs]e(?: version| v)? 1 0
name cddl: common development and distribution licen[cs]e
[cddl]
id cddl-1: spdx license identifier cddl 1 0
id cddl-1.1: spdx license identifier cddl 1 1
[common public]
name cpl-1: common public licen[cs]e(?: version| v)? 1 0
name cpal-1: common public attribution licen[cs]e(?: version| v)? 1 0
[zlib]
id zlib: spdx license identifier zlib
notice zlib: licensed under (?:the )?zlib(?: libpng)?(?: licen[cs]e)?
name zlib: zlib(?: libpng)? licen[cs]e
[altered source versions]
text zlib: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
[boost]
header bsl-1: distributed under the boost software license version 1 0
id bsl-1: spdx license identifier bsl 1 0 boost
url bsl-1: boost org license 1 0 txt
name bsl-1: boost software licen[cs]e(?: version| v)? 1(?: 0)?
name bsl-1: boost software licen[cs]e
[artistic]
id artistic-2: spdx license identifier artistic 2 0
notice artistic-2: under (?:the )?(?:terms of (?:the )?)?artistic licen[cs]e(?: version)? 2 0
name artistic-2: artistic licen[cs]e(?: version| v)? 2(?: 0)?
name artistic-1: artistic licen[cs]e(?: version| v)? 1(?: 0)?
name artistic: artistic licen[cs]e
[same terms as perl]
header perl: redistribute it and or modify it under the same terms as perl itself licen[cs]e
[python software foundation]
text python-2: python software foundation license version 2
name python-2: python software foundation licen[cs]e
[postgresql]
id postgresql: spdx license identifier postgresql
name postgresql: postgresql licen[cs]e
[unlicense]
id unlicense: spdx license identifier unlicense
url unlicense: unlicense org
notice unlicense: (?:licensed|released) under (?:the )?unlicense
name unlicense: the unlicense
[unencumbered software released into the public domain]
text unlicense: this is free and unencumbered software released into the public domain
[wtfpl]
id wtfpl: spdx license identifier wtfpl
notice wtfpl: licensed under (?:the )?wtfpl
short wtfpl: wtfpl licen[cs]ed?
[do what the fuck you want to public]
name wtfpl: do what the fuck you want to public licen[cs]e
[microsoft]
id ms-pl: spdx license identifier ms pl microsoft
name ms-pl: microsoft public licen[cs]e
name ms-rl: microsoft reciprocal licen[cs]e
[open font]
header ofl-1.1: this font software is licensed under the sil open font license version 1 1
name ofl-1.1: sil open font licen[cs]e(?: version| v)? 1 1
name ofl: (?:sil )?open font licen[cs]e
[ofl]
id ofl-1.1: spdx license identifier ofl 1 1
[open database]
notice odbl-1: (?:made available|licensed) under the open database licen[cs]e
name odbl-1: open database licen[cs]e(?: version| v)?(?: 1 0)?
[open data commons]
name odc-by-1: open data commons attribution licen[cs]e
name pddl-1: open data commons public domain dedication and licen[cs]e
[open government]
name ogl-3: open government licen[cs]e(?: v| version)? 3 0
name ogl: open government licen[cs]e
[cc0]
id cc0-1: spdx license identifier cc0 1 0
notice cc0-1: (?:licensed|released|available|dedicated) under (?:the )?cc0(?: 1 0)?
name cc0-1: cc0 1 0(?: universal)?
name cc0-1: cc0 licen[cs]e
[publicdomain zero]
url cc0-1: creativecommons org publicdomain zero 1 0
[creativecommons org licenses]
url cc-by: creativecommons org licenses by
url cc-by-sa: creativecommons org licenses by sa
url cc-by-nd: creativecommons org licenses by nd
url cc-by-nc: creativecommons org licenses by nc
url cc-by-nc-sa: creativecommons org licenses by nc sa
url cc-by-nc-nd: creativecommons org licenses by nc nd
[cc by]
id cc-by: spdx license identifier cc by [1-4] [05]
id cc-by-sa: spdx license identifier cc by sa [1-4] [05]
id cc-by-nc: spdx license identifier cc by nc [1-4] [05]
name cc-by: cc by(?: [1-4] [05])?
name cc-by-sa: cc by sa(?: [1-4] [05])?
name cc-by-nd: cc by nd(?: [1-4] [05])?
name cc-by-nc: cc by nc(?: [1-4] [05])?
name cc-by-nc-sa: cc by nc sa(?: [1-4] [05])?
name cc-by-nc-nd: cc by nc nd(?: [1-4] [05])?
[cc attribution]
name cc-by: cc attribution(?: [1-4] [05])?
name cc-by-sa: cc attribution share ?alike(?: [1-4] [05])?
name cc-by-nd: cc attribution no ?derivat?ive?s(?: [1-4] [05])?
name cc-by-nd: cc attribution no ?derivs(?: [1-4] [05])?
name cc-by-nc: cc attribution non ?commercial(?: [1-4] [05])?
name cc-by-nc-sa: cc attribution non ?commercial share ?alike(?: [1-4] [05])?
name cc-by-nc-nd: cc attribution non ?commercial no ?derivat?ive?s(?: [1-4] [05])?
name cc-by-nc-nd: cc attribution non ?commercial no ?derivs(?: [1-4] [05])?
[creative commons]
name cc-by: creative commons(?: by| attribution)(?: [1-4] [05])?
name cc-by-sa: creative commons(?: by sa| attribution share ?alike)(?: [1-4] [05])?
name cc-by-nd: creative commons(?: by nd| attribution no ?derivat?ive?s| attribution no ?derivs)(?: [1-4] [05])?
name cc-by-nc: creative commons(?: by nc| attribution non ?commercial)(?: [1-4] [05])?
name cc-by-nc-sa: creative commons(?: by nc sa| attribution non ?commercial share ?alike)(?: [1-4] [05])?
name cc-by-nc-nd: creative commons(?: by nc nd| attribution non ?commercial no ?derivat?ive?s| attribution non ?commercial no ?derivs)(?: [1-4] [05])?
name cc0-1: creative commons zero(?: v)?(?: 1 0)?
short cc: creative commons licen[cs]ed?
[openssl]
text openssl: this product includes software developed by the openssl project for use in the openssl toolkit
id openssl: spdx license identifier openssl
name openssl: openssl licen[cs]e
[php license]
text php-3.01: the php license version 3 01
name php: php license
[ruby license]
name ruby: ruby license
[w3c]
id w3c: spdx license identifier w3c
name w3c: w3c software(?: notice)?(?: and)? licen[cs]e
[business source]
name busl-1.1: business source licen[cs]e(?: version)? 1 1
name busl: business source licen[cs]e
[server side public]
name sspl-1: server side public licen[cs]e(?: version| v)? 1
name sspl: server side public licen[cs]e
[elastic license]
name elastic-2: elastic license 2 0
name elastic: elastic license
[commons clause]
name commons-clause: commons clause license condition
[open software license]
name osl-3: open software license(?: version| v)? 3 0
name osl: open software license
[academic free]
name afl-3: academic free licen[cs]e(?: version| v)? 3 0
name afl: academic free licen[cs]e
[mulan]
name mulan-psl-2: mulan psl v2
[blueoak]
id blueoak-1: spdx license identifier blueoak 1 0 0
[blue oak]
name blueoak-1: blue oak model licen[cs]e
[llama]
name llama-3: (?:meta )?llama 3(?: 1)? community license
name llama-2: llama 2 community license
[openrail]
name openrail-m: (?:bigscience |creativeml )?openrail m(?: licen[cs]e)?
[all rights reserved]
short proprietary: copyright all rights reserved
[proprietary and confidential]
short proprietary: proprietary and confidential unauthorized copying of this file
[without express or implied warranty]
text hpnd: it is provided as is without express or implied warranty
"""

#: Parts of words: every match of a base phrase or rule holds a word with one of them, or a word that begins with one of
#: BEGINNINGS (these parts alone stand in too many other words).
STEMS = ("licen", "gpl", "gnu", "spdx", "apache", "mozilla", "bsd", "creativ", "copyright", "permission", "redistribut", "contributors", "warrant", "eupl", "eclipse", "cc0", "consortium", "altered", "advertising", "mulan", "openrail", "unauthorized", "openssl", "unencumbered")
BEGINNINGS = ("cc", "mpl", "asl")


def rules() -> list[dict]:
    """label, keyword, priority, confidence, pattern and place (nth) of every rule, in order."""
    out, keyword = [], ""
    for line in SIGNATURES.strip().splitlines():
        if line.startswith("["):
            keyword = line[1:-1]
            continue
        head, pattern = line.split(": ", 1)
        kind, label = head.split(" ")
        priority, confidence = KINDS[kind]
        out.append({"label": label, "keyword": keyword, "priority": priority, "confidence": confidence, "pattern": f"(?<= )(?:{pattern})(?= )"})
    out.sort(key=lambda r: -r["priority"])
    return [r | {"nth": n} for n, r in enumerate(out)]
