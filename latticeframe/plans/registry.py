"""Every operator by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from ..functions import reals
from ..operators import convolution, creation, elementwise, filters, fourier, indexing, lanes, linalg, reductions, shape, sorting, strings, windows
from ..sources import files
from ..streaming import signals
from ..tensor import Tensor


def rtlock(t: Tensor) -> Tensor:
    """Marks an array; the mark is carried along and changes nothing else."""
    return replace(t, realtime=True)


def rtunlock(t: Tensor) -> Tensor:
    return replace(t, realtime=False)


#: Whether arrays are to be marked as they are made: by session state, as the marks have no effect on plans.
MARKING = {"note": False, "all": False}


def rtlockstart() -> None:
    MARKING["note"] = True


def rtlockend() -> None:
    MARKING["note"] = False


def rtlockall() -> None:
    MARKING["all"] = True


def _of(module, *names: str) -> dict[str, Callable]:
    return {n: getattr(module, n) for n in names}


OPERATORS: dict[str, Callable] = {}
OPERATORS |= _of(creation, *"empty zeros ones full like identity arange linspace logspace geomspace rand randint seed".split())
OPERATORS |= _of(creation, *"fromarray toarray copy dims size shape isempty".split())
OPERATORS |= {"fromftable": creation.fromtable, "toftable": creation.totable, "type": creation.type_, "print": creation.text, "k": signals.triggered, "i": signals.frozen}
OPERATORS |= {"save": files.save, "load": files.load, "loadaudiofile": files.load_audio, "saveaudiofile": files.save_audio}
OPERATORS |= _of(shape, *"reshape flatten transpose flip roll reverse pad truncate head resize concat stack frame insert remove push pop".split())
OPERATORS |= _of(indexing, *"get getrow getcol set getslice setslice take compress select indexof bincount searchsorted argwhere argnonzero argisnan".split())
OPERATORS |= _of(elementwise, *"where putmask clip foreach wrap real imag angle conj tocomplex toreal".split())
OPERATORS |= {"divmod": elementwise.divmod_, "next": signals.next_}
OPERATORS |= {n: partial(elementwise.binary, n) for n in reals.BINARY if n != "wrap"}
OPERATORS |= {n: partial(elementwise.unary, n) for n in reals.UNARY | reals.TESTS}
OPERATORS |= {n: partial(strings.apply, n) for n in strings.MAPS | strings.NUMBER_MAPS}
OPERATORS |= {n: partial(strings.spread, n) for n in strings.SPREADS}
OPERATORS |= {"stradd": strings.concat, "strmul": strings.repeat, "strjoin": reductions.strjoin, "strfromascii": strings.fromcodes, "strdecode": strings.decode}
OPERATORS |= {"strfromcodepoints": strings.fromcodepoints, "listasstr": strings.listasstr, "tobuffer": strings.tobuffer, "frombuffer": strings.frombuffer}
OPERATORS |= {n: partial(reductions.reduce, n) for n in reductions.REAL_MODES}
OPERATORS |= _of(reductions, *"sub cnteq quantile percentile argmin argmax norm".split())
OPERATORS |= _of(lanes, *"cumsum cumprod diff grad movmean movmedian movmin movmax movstd movvar medfilt1d medfilt unwrap normalize zcr".split())
OPERATORS |= _of(sorting, *"sort argsort unique argunique shuffle perm likeset unlikeset setinsert setremove setcontains".split())
OPERATORS |= _of(sorting, *"setunion setintersect setdiff setsymdiff setissubset setissuperset setisdisjoint setisequal".split())
OPERATORS |= _of(linalg, *"dot inner outer matmul trace diag cross dist pairdist angledist project reject reflect solve inv det savgol hilbertmat".split())
OPERATORS |= _of(fourier, *"fft rfft ifft irfft fft2 rfft2 ifft2 irfft2 stft istft fftfreq rfftfreq fftshift ifftshift".split())
OPERATORS |= _of(fourier, *"dctone1d dcttwo1d dstone1d dsttwo1d hilbert1d hilbert1dr hilbert2 mfcc mfbank mlogfbank".split())
OPERATORS |= _of(convolution, *"convolve1d correlate1d convolve correlate fftconvolve1d fftcorrelate1d fftconvolve fftcorrelate".split())
OPERATORS |= _of(convolution, *"deconvolve1d decorrelate1d deconvolve decorrelate fftdeconvolve1d fftdecorrelate1d fftdeconvolve fftdecorrelate".split())
OPERATORS |= _of(convolution, *"interp resample lagrange roots amdf".split())
OPERATORS |= _of(filters, *"lptolpzpk lptohpzpk lptobpzpk lptobszpk bilinearzpk tftozpk zpktotf lptolp lptohp lptobp lptobs zpktosos buttap".split())
OPERATORS |= _of(filters, *"lfilter sosfilter zlfilter zsosfilter".split())
for _name in filters.PROTOTYPES:
    OPERATORS |= {f"{_name}ba": partial(filters.design_ba, _name), f"{_name}sos": partial(filters.design_sos, _name), f"rt{_name}": partial(signals.rt, _name)}
OPERATORS |= _of(windows, *"hanning hamming bartlett blackman kaiser poltocar cartopol cyltocar cartocyl sphtocar cartosph hoatocar cartohoa".split())
OPERATORS |= _of(windows, *"rotmat rotmatypr nmtoacn acntonm hoaordtochnls chnlstohoaord sn3dton3d n3dtosn3d legendre sphharm sphharmacn".split())
OPERATORS |= _of(windows, *"t60sab t60eyr rt60absp fschrd fpqr t60tofbg fbgtot60".split())
OPERATORS |= {"samptomillis": reals.samples_to_millis, "samptosec": reals.samples_to_seconds, "millistosamp": reals.millis_to_samples, "sectosamp": reals.seconds_to_samples}
OPERATORS |= {"fromaudio": signals.blocks, "toaudio": signals.unblock, "pack": signals.pack, "unpack": signals.unpack, "snap": signals.snap, "stream": signals.overlap_add}
OPERATORS |= {f.__name__: f for f in (rtlock, rtunlock, rtlockstart, rtlockend, rtlockall)}
#: The language's operators; the in-place ones rebind a name, as in ``a += b``.
SYNTAX = {
    "+": Tensor.__add__,
    "-": Tensor.__sub__,
    "*": Tensor.__mul__,
    "/": Tensor.__truediv__,
    "^": Tensor.__pow__,
    "[]": Tensor.__getitem__,
    "[...]": Tensor.of,
    "[]=": Tensor.put,
    "=": creation.copy,
}
