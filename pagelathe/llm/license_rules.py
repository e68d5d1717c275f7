"""Signature rules of licenses, in order: label | keyword | pattern over a text's words (lower case, one blank between).

The keyword must occur in the text for the pattern to run. Of overlapping detections the one whose rule has the
higher priority stays, and one that contains another suppresses it; `specific` families come before `general` ones.
"""

from __future__ import annotations

#: Base phrases and their labels (fixed values).
BASE: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Priority 90: names with a version, and sentences that only one license has.
SPECIFIC = r"""
agpl-3.0 | affero | gnu affero general public license (as published by the free software foundation )?(either )?(version|v) ?3
agpl-3.0 | agpl | agpl ?v? ?3( 0)?( (only|or later))?
agpl-1.0 | affero | affero general public license (version|v) ?1
gpl-3.0 | gnu | gnu general public license (as published by the free software foundation )?(either )?(version|v) ?3( 0)?
gpl-3.0 | gpl | gplv? ?3( 0)?( (only|or later))?
gpl-2.0 | gnu | gnu general public license (as published by the free software foundation )?(either )?(version|v) ?2( 0)?
gpl-2.0 | gpl | gplv? ?2( 0)?( (only|or later))?
gpl-1.0 | gnu | gnu general public license (either )?(version|v) ?1( 0)?
gpl-classpath | classpath | classpath exception
gpl-linking | exception | special exception the copyright holders of this library give you permission to link
lgpl-3.0 | lesser | gnu lesser general public license (as published by the free software foundation )?(either )?(version|v) ?3
lgpl-2.1 | lesser | gnu lesser general public license (as published by the free software foundation )?(either )?(version|v) ?2 1
lgpl-2.0 | library | gnu library general public license (as published by the free software foundation )?(either )?(version|v) ?2
lgpl-3.0 | lgpl | lgplv? ?3( 0)?( (only|or later))?
lgpl-2.1 | lgpl | lgplv? ?2 1( (only|or later))?
lgpl-2.0 | lgpl | lgplv? ?2 0( (only|or later))?
fdl-1.3 | documentation | gnu free documentation license (version|v) ?1 3
fdl-1.2 | documentation | gnu free documentation license (version|v) ?1 2
fdl-1.1 | documentation | gnu free documentation license (version|v) ?1 1
apache-2.0 | apache | apache license (version|v) ?2( 0)?
apache-2.0 | apache | apache (2 0|2) license
apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance
apache-2.0 | apache | (www )?apache org licenses license 2 0
apache-1.1 | apache | apache (software )?license (version|v) ?1 1
apache-1.0 | apache | apache (software )?license (version|v) ?1 0
mpl-2.0 | mozilla | mozilla public license (version|v) ?2( 0)?
mpl-2.0 | mozilla | subject to the terms of the mozilla public license v 2 0
mpl-1.1 | mozilla | mozilla public license (version|v) ?1 1
mpl-1.0 | mozilla | mozilla public license (version|v) ?1 0
mpl-2.0 | mpl | mpl ?v? ?2( 0)?
mpl-1.1 | mpl | mpl ?v? ?1 1
epl-2.0 | eclipse | eclipse public license (version|v)? ?2 0
epl-1.0 | eclipse | eclipse public license (version|v)? ?1 0
epl-2.0 | epl | epl ?v? ?2 0
epl-1.0 | epl | epl ?v? ?1 0
edl-1.0 | eclipse | eclipse distribution license (version|v)? ?1 0
eupl-1.2 | european | european union public licen[cs]e (version|v)? ?1 2
eupl-1.1 | european | european union public licen[cs]e (version|v)? ?1 1
eupl-1.2 | eupl | eupl ?v? ?1 2
cddl-1.1 | common | common development and distribution license (version|v)? ?1 1
cddl-1.0 | common | common development and distribution license (version|v)? ?1 0
cddl-1.0 | cddl | cddl ?v? ?1 0
cpl-1.0 | common | common public license (version|v)? ?1 0
ipl-1.0 | ibm | ibm public license (version|v)? ?1 0
osl-3.0 | open software | open software license (version|v)? ?3 0
osl-2.1 | open software | open software license (version|v)? ?2 1
afl-3.0 | academic | academic free license (version|v)? ?3 0
afl-2.1 | academic | academic free license (version|v)? ?2 1
artistic-2.0 | artistic | artistic license (version|v)? ?2 0
artistic-1.0 | artistic | artistic license (version|v)? ?1 0
boost-1.0 | boost | boost software license (version|v)? ?1 0
boost-1.0 | bsl | bsl 1 0
bsl-1.1 | business | business source license (version|v)? ?1 1
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
ofl-1.1 | sil | sil open font license (version|v)? ?1 1
ofl-1.0 | sil | sil open font license (version|v)? ?1 0
zpl-2.1 | zope | zope public license (version|v)? ?2 1
zpl-2.0 | zope | zope public license (version|v)? ?2 0
php-3.01 | php | php license (version|v)? ?3 01
php-3.0 | php | php license (version|v)? ?3 0
psf-2.0 | python | python software foundation license (version|v)? ?2
psf-2.0 | psf | psf license agreement
cnri-python | cnri | cnri (python|open source) license
unicode-dfs | unicode | unicode inc license agreement data files and software
w3c | w3c | w3c software (notice and )?license
curl | curl | curl license
openssl | openssl | openssl (and ssleay )?licenses?
openssl | openssl | this product includes software developed by the openssl project
vim | vim | vim license
sleepycat | sleepycat | sleepycat license
naumen | naumen | naumen public license
nasa-1.3 | nasa | nasa open source agreement (version|v)? ?1 3
ncsa | illinois | university of illinois ncsa open source license
ncsa | ncsa | ncsa open source license
upl-1.0 | universal | universal permissive license( (version|v)? ?1 0)?
ecl-2.0 | educational | educational community license( (version|v)? ?2 0)?
cecill-2.1 | cecill | cecill( free software license agreement)? (version|v)? ?2 1
cecill-b | cecill | cecill b
cecill-c | cecill | cecill c
mulan-2.0 | mulan | mulan (psl|permissive software license) ?(version|v)? ?2
sspl-1.0 | server side | server side public license( (version|v)? ?1)?
elastic-2.0 | elastic | elastic license( (version|v)?)? ?2 0
commons-clause | commons clause | commons clause( license condition)?( v1 0)?
polyform | polyform | polyform (noncommercial|small business|strict|shield) license
hippocratic | hippocratic | hippocratic license
json | evil | the software shall be used for good not evil
beerware | beer | beer ?ware license
beerware | beer | you can buy me a beer in return
wtfpl | public license | do what the fuck you want to public license
wtfpl | wtfpl | wtfpl
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unlicense | (the unlicense|unlicense org)
cc0-1.0 | cc0 | cc0( 1 0)?( universal)?
cc0-1.0 | zero | creative commons zero( (version|v)? ?1 0)?
cc0-1.0 | publicdomain | creativecommons org publicdomain zero 1 0
pddl-1.0 | dedication | (open data commons )?public domain dedication (and|&) license
odbl-1.0 | database | open (data commons open )?database license
odc-by-1.0 | attribution | open data commons attribution license
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
bsd-4-clause | bsd | bsd 4 clause
bsd-3-clause | bsd | (bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)( license)?
bsd-3-clause | endorse | neither the name of .{1,120}? may be used to endorse or promote products derived from this software
bsd-2-clause | bsd | (bsd 2 clause|2 clause bsd|simplified bsd|freebsd)( license)?
bsd-0-clause | bsd | (zero clause bsd|0bsd|bsd zero clause)( license)?
isc | isc | isc license
isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mit | mit | (the )?mit licen[cs]e
mit | mit | licensed under (the )?(terms of (the )?)?mit
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | expat | expat license
mit-0 | mit | mit (0|no attribution)( license)?
x11 | x11 | x11 license
zlib | zlib | zlib( libpng)? license
zlib | altered | altered source versions must be plainly marked as such
libpng | libpng | libpng license
ibm-pibs | ibm | ibm powerpc initialization and boot software
intel | intel | intel open source license
sgi-b-2.0 | sgi | sgi free software license b( (version|v)? ?2 0)?
ruby | ruby | ruby license
tcl | tcl | tcl tk license
ijg | jpeg | independent jpeg group
freetype | freetype | freetype (project )?license
imagemagick | imagemagick | imagemagick license
info-zip | info zip | info zip license
qpl-1.0 | q public | q public license( (version|v)? ?1 0)?
lppl-1.3 | latex | latex project public license( (version|v)? ?1 3[a-c]?)?
"""

#: Priority 80: Creative Commons, from the fuller names to the shorter.
CREATIVE = r"""
cc-by-nc-nd | nd | cc by nc nd( (\d) (\d))?( international| unported| generic)?
cc-by-nc-nd | deriv | creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?( (\d) (\d))?( international| unported| generic)?
cc-by-nc-sa | sa | cc by nc sa( (\d) (\d))?( international| unported| generic)?
cc-by-nc-sa | alike | creative commons attribution non ?commercial share ?alike( (\d) (\d))?( international| unported| generic)?
cc-by-nc | nc | cc by nc( (\d) (\d))?( international| unported| generic)?
cc-by-nc | commercial | creative commons attribution non ?commercial( (\d) (\d))?( international| unported| generic)?
cc-by-nd | nd | cc by nd( (\d) (\d))?( international| unported| generic)?
cc-by-nd | deriv | creative commons attribution no ?deriv(ative)?s?( works)?( (\d) (\d))?( international| unported| generic)?
cc-by-sa | sa | cc by sa( (\d) (\d))?( international| unported| generic)?
cc-by-sa | alike | creative commons attribution share ?alike( (\d) (\d))?( international| unported| generic)?
cc-by-sa | creativecommons | creativecommons org licenses by sa( (\d) (\d))?
cc-by-nc | creativecommons | creativecommons org licenses by nc( (\d) (\d))?
cc-by-nd | creativecommons | creativecommons org licenses by nd( (\d) (\d))?
cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa( (\d) (\d))?
cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd( (\d) (\d))?
cc-by-sa | creativecommons | creativecommons org licenses by sa( (\d) (\d))?
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc-by-2.5 | cc | cc by 2 5
cc-by-2.0 | cc | cc by 2 0
cc-by-4.0 | creative | creative commons attribution 4 0( international)?( public)?( license)?
cc-by-3.0 | creative | creative commons attribution 3 0( unported)?( license)?
cc-by-2.0 | creative | creative commons attribution 2 0( generic)?( license)?
cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | creativecommons org licenses by 3 0
cc-by | creative | creative commons attribution( license)?
cc-pdm | mark | (creative commons )?public domain mark( 1 0)?
"""

#: Priority 60: names without a version.
NAMES = r"""
agpl | affero | (gnu )?affero general public licen[cs]e
agpl | agpl | agpl
lgpl | lesser | (gnu )?lesser general public licen[cs]e
lgpl | library | gnu library (or lesser )?general public licen[cs]e
lgpl | lgpl | lgpl
gpl | gnu | gnu (general )?public licen[cs]e
gpl | gpl | (gnu )?gpl( licen[cs]e)?
fdl | documentation | (gnu )?free documentation licen[cs]e
fdl | gfdl | gfdl
apache | apache | apache (software )?licen[cs]e
apache | apache | apache licensed
mpl | mozilla | mozilla public licen[cs]e
epl | eclipse | eclipse public licen[cs]e
eupl | european | european union public licen[cs]e
cddl | cddl | cddl
cddl | common | common development and distribution licen[cs]e
bsd | bsd | bsd (style )?licen[cs]e
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
artistic | artistic | artistic licen[cs]e
perl | perl | same terms as perl( itself)?
boost | boost | boost software licen[cs]e
osl | open software | open software licen[cs]e
afl | academic | academic free licen[cs]e
ofl | font | open font licen[cs]e
zpl | zope | zope public licen[cs]e
php | php | php licen[cs]e
psf | python | python (software foundation )?licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
oracle | oracle | oracle (binary code|technology network) licen[cs]e
sun | sun | sun (public|binary code|industry standards source) licen[cs]e
apple | apple | apple (public source|sample code) licen[cs]e
netscape | netscape | netscape public licen[cs]e
nokia | nokia | nokia open source licen[cs]e
realnetworks | realnetworks | realnetworks public source licen[cs]e
ricoh | ricoh | ricoh source code public licen[cs]e
sybase | sybase | sybase open watcom public licen[cs]e
vovida | vovida | vovida software licen[cs]e
wxwindows | wxwindows | wxwindows library licen[cs]e
xfree86 | xfree86 | xfree86 licen[cs]e
eiffel | eiffel | eiffel forum licen[cs]e
entessa | entessa | entessa public licen[cs]e
frameworx | frameworx | frameworx open licen[cs]e
lucent | lucent | lucent public licen[cs]e
motosoto | motosoto | motosoto open source licen[cs]e
nethack | nethack | nethack general public licen[cs]e
oclc | oclc | oclc research public licen[cs]e
reciprocal | reciprocal | reciprocal public licen[cs]e
simple-public | simple | simple public licen[cs]e
cpal | attribution | common public attribution licen[cs]e
adaptive | adaptive | adaptive public licen[cs]e
attribution-assurance | assurance | attribution assurance licen[cs]e
fair | fair | fair licen[cs]e
historical | historical | historical permission notice and disclaimer
isc | isc | isc licensed
mit | mit | mit (style|licensed|x11)
cern-ohl | cern | cern open hardware licen[cs]e
tapr | tapr | tapr open hardware licen[cs]e
solderpad | solderpad | solderpad hardware licen[cs]e
ogl | government | open government licen[cs]e
licence-ouverte | ouverte | licence ouverte
dl-de | datenlizenz | datenlizenz deutschland
etalab | etalab | etalab( 2 0)?
cdla | cdla | cdla (permissive|sharing)
cdla | community | community data license agreement (permissive|sharing)
llama | llama | llama [0-9] community licen[cs]e
openrail | openrail | (bigscience |creativeml )?open ?rail( m)?( licen[cs]e)?
gemma | gemma | gemma terms of use
"""

#: Priority 40: what says that a license is there, but not which.
GENERAL = r"""
copyleft | copyleft | copyleft
public-domain | domain | (in|into|to) the public domain
public-domain | gemeinfrei | gemeinfrei
public-domain | domaine | domaine public
public-domain | dominio | dominio p.blico
proprietary | proprietary | proprietary (and confidential|license|software)
all-rights-reserved | rights | all rights reserved
all-rights-reserved | rechte | alle rechte vorbehalten
all-rights-reserved | droits | tous droits r.serv.s
all-rights-reserved | derechos | todos los derechos reservados
creative-commons | creative | creative commons
spdx | spdx | spdx license identifier [a-z0-9]+( [a-z0-9]+){0,3}
eula | user licen | end user licen[cs]e agreement
licensed | licensed | licensed under (the|a) [a-z]+
as-is | provided | provided as is without (any )?(warranty|warranties)
no-warranty | warranty | without warranty of any kind
copyright | copyright | copyright (c )?(19|20)\d\d
"""


def ordered() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) of all rules, the base phrases first."""
    out = [(label, 100, phrase.split(" ")[0], phrase) for phrase, label in BASE]
    for priority, block in ((90, SPECIFIC), (80, CREATIVE), (60, NAMES), (40, GENERAL)):
        for line in block.strip().splitlines():
            label, keyword, pattern = line.split(" | ")
            out.append((label, priority, keyword, pattern))
    return out
