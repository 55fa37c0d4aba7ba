"""Query plans: the AASQL compiler and the projection of star tables."""
