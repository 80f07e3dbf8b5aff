from qoeflow.operators.policy.base import Policy  # noqa: F401
from qoeflow.operators.policy.ducb import DiscountedUCB  # noqa: F401
from qoeflow.operators.policy.epsilon import EpsilonGreedy  # noqa: F401
from qoeflow.operators.policy.state import StatePolicy  # noqa: F401
