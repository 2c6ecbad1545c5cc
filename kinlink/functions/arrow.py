"""Moving array columns between Arrow and NumPy without touching rows in Python."""

import numpy as np
import pyarrow as pa


def list_matrix(column, dtype=np.float64):
    """Valid rows of an equal-length list column as a matrix, and the validity of each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    rows = int(valid.sum())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    width = len(flat) // rows if rows else 0
    lengths = np.diff(column.offsets.to_numpy())[valid]
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"lists of {lengths.min()} to {lengths.max()} values where one length is needed")
    return valid, flat.reshape(rows, width)


def matrix_list(valid, matrix, arrow_type):
    """The inverse of ``list_matrix``: null where ``valid`` is false."""
    width = matrix.shape[1] if matrix.ndim == 2 else 0
    offsets = np.zeros(len(valid) + 1, dtype=np.int32)
    np.cumsum(np.where(valid, width, 0), out=offsets[1:])
    values = pa.array(np.ascontiguousarray(matrix).ravel(), type=arrow_type)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(~valid))
