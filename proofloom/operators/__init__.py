"""proofloom.operators"""
